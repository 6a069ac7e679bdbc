"""Query of operator 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvox.llm import collocations
from tabvox.llm.queries.tables import read


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents").select("text", "lang"), longest=5, least=100, top=2000)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every n-gram is made and counted by itself.
ORACLE_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  lists AS (SELECT lang, row_number() OVER () AS piece, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
  words AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
  ahead AS (SELECT lang, w, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
  grams AS (SELECT lang, [w] AS p FROM ahead UNION ALL SELECT lang, [w, b] FROM ahead WHERE b IS NOT NULL UNION ALL SELECT lang, [w, b, c] FROM ahead WHERE c IS NOT NULL
    UNION ALL SELECT lang, [w, b, c, d] FROM ahead WHERE d IS NOT NULL UNION ALL SELECT lang, [w, b, c, d, e] FROM ahead WHERE e IS NOT NULL),
  f AS (SELECT lang, p, len(p) AS k, count(*) AS f FROM grams GROUP BY ALL),
  n AS (SELECT lang, sum(f)::hugeint AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT * FROM f WHERE k >= 2 AND f >= 100),
  inside AS (SELECT DISTINCT s.lang, s.p FROM c s JOIN c b ON s.lang = b.lang AND b.k > s.k AND 100 * b.f >= 100 * s.f AND contains(' ' || array_to_string(b.p, ' ') || ' ', ' ' || array_to_string(s.p, ' ') || ' ')),
  cuts AS (SELECT c.lang, c.p, c.f AS a, j.j, x.f AS l, y.f AS r, n.n, (1000::hugeint * c.f * n.n) // (x.f::hugeint * y.f) AS score
    FROM c JOIN (SELECT unnest([1, 2, 3, 4]) AS j) j ON j.j < c.k JOIN f x ON x.lang = c.lang AND x.p = c.p[1:j.j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j.j + 1:c.k] JOIN n ON n.lang = c.lang
    ANTI JOIN inside i ON i.lang = c.lang AND i.p = c.p),
  best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
  ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked WHERE rank <= 2000"""
