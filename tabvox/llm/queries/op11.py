"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvox.llm import merkle
from tabvox.llm.queries.tables import read
from tabvox.llm.textbytes import fold

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    changed = merkle.leaf(*[F.col("n_chars").cast("long") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    claim = F.when((fold(F.col("doc_id"), 7) == 0) & F.col("n_chars").isNotNull(), changed)
    return merkle.manifest(docs, COLUMNS, claim=claim).drop("path")


def _sql(levels: int = 40) -> str:
    """The tree level by level: two nodes' digests are joined and hashed while a group has more than one."""
    part = lambda c: f"coalesce(strlen(cast({c} AS varchar))::varchar || ':' || cast({c} AS varchar), '-')"
    leaf = lambda n: f"sha256({' || '.join(part(n if c == 'n_chars' else c) for c in COLUMNS)})"
    # crc32 of the decimal digits, bit by bit
    bit = "CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id AS varchar), ''), lambda x: ascii(x)::bigint)), lambda h, c: list_reduce(list_prepend(xor(h, c), [0::bigint,0,0,0,0,0,0,0]), lambda a, z: {bit})), 4294967295)"
    base = f"""leaves AS (SELECT coalesce('=' || lang, '-') AS g, doc_id, {leaf("n_chars")} AS leaf,
      CASE WHEN {crc} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("n_chars + 1")} END AS claim FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM leaves)"""

    def tree(of: str, to: str) -> str:
        """Nodes (g, level, pos, digest, total) of all levels."""
        steps = [f"{to}0 AS (SELECT g, 0 AS level, pos, digest, total FROM {of})"]
        for k in range(levels):
            steps.append(f"{to}{k + 1} AS (SELECT g, {k + 1} AS level, pos // 2 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (total + 1) // 2 AS total FROM {to}{k} WHERE total > 1 GROUP BY g, pos // 2, total)")
        return ", ".join(steps) + f", {to} AS ({' UNION ALL '.join(f'SELECT * FROM {to}{k}' for k in range(levels + 1))})"

    return f"""WITH {base}, low AS (SELECT g, pos, leaf AS digest, total FROM l), {tree("low", "n")},
    roots AS (SELECT g AS name, digest FROM n WHERE total = 1),
    high AS (SELECT 'all' AS g, row_number() OVER (ORDER BY name) - 1 AS pos, digest, count(*) OVER () AS total, name FROM roots), {tree("high", "h")},
    steps AS (
      SELECT l.g, l.pos, n.level AS level, (l.pos >> n.level) & 1 AS side, s.digest AS sib FROM l JOIN n ON n.g = l.g AND n.pos = l.pos >> n.level AND n.total > 1 LEFT JOIN n s ON s.g = n.g AND s.level = n.level AND s.pos = xor(n.pos, 1)
      UNION ALL
      SELECT l.g, l.pos, 100 + h.level, (high.pos >> h.level) & 1, s.digest FROM l JOIN high ON high.name = l.g JOIN h ON h.pos = high.pos >> h.level AND h.total > 1 LEFT JOIN h s ON s.level = h.level AND s.pos = xor(h.pos, 1)),
    paths AS (SELECT g, pos, string_agg(coalesce(sib, ''), '' ORDER BY level) AS proof, list(side || coalesce(sib, '') ORDER BY level) AS path FROM steps GROUP BY g, pos),
    out AS (SELECT l.doc_id, l.leaf, roots.digest AS subroot, (SELECT digest FROM h WHERE total = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
      list_reduce(list_prepend(coalesce(l.claim, l.leaf), coalesce(p.path, [])), lambda a, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
      FROM l JOIN roots ON roots.name = l.g LEFT JOIN paths p ON p.g = l.g AND p.pos = l.pos)
    SELECT *, folded_root = root AS verified FROM out"""


ORACLE_SQL = _sql()
