"""The block view of documents: every line becomes a block of a two-column page, with the atoms that the
fidelity operators look for set into it by rule. blocks() and BLOCKS_SQL state the same view for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that is set behind a line, and the block that follows it, by k; {m} and {n} are numbers of the line and document.
TAILS = {
    0: " see Fig. {m}(a) and Table II now",
    1: " reaches {n}.5 Gb/s at 3 dB loss [{m}] today",
    2: " where Δv ≤ 2 μV holds α ≠ β there",
    3: " uses V_DD and C_ox here",
    5: " on March {m}, 2019 we measured (2021) data",
    6: " about 10<sup>−</sup><sup>1{m}</sup> and x<sub>i</sub> left",
    9: " with gm and VDD near Ipd and RCIN or f3dB by v1 done",
}
EXTRAS = {2: "ω_c ≈ 3", 4: "Vout = Gain × Vin ({m})", 6: "I_d × g_m", 7: "{m}. Methods And Results", 8: "Fig. {m} Measured spectrum of the device"}
#: What a translation changes, by t: SQL that both engines take, over text.
CHANGES = {
    1: "replace(text, 'Fig. ', '图 ')",
    2: "replace(text, '[' || m || ']', '')",
    3: "replace(text, '.5 Gb/s', '')",
    4: "replace(text, '≤', '≥')",
    5: "text || ' · α'",
    6: "replace(text, '2019', '₂₀₁₉')",
    7: "''",
    8: "'[翻译失败: timeout]'",
    9: "'[MERGED_INTO:b_' || page || '_' || (page * 6 - 6) || ']'",
    10: "text || ' [[KEEP_0123456789ab_9]]'",
}
_CASES = " ".join(f"WHEN {t} THEN {sql}" for t, sql in CHANGES.items())
# what follows from ord, doc_id and text; the same SQL in both engines
_LAID = """
SELECT doc_id, ord, page, slot, k, m, line, text, source_id, type,
  type <> 'formula' AS translate,
  CAST(CASE WHEN slot < 3 THEN 50 ELSE 320 END AS DOUBLE) AS x0, CAST(CASE WHEN slot < 3 THEN 300 ELSE 570 END AS DOUBLE) AS x1,
  y0, y0 + h AS y1, CAST(CASE WHEN page = 1 AND slot = 0 THEN 18 ELSE 9 + k % 3 END AS DOUBLE) AS font_size,
  t, t = 11 AS vision,
  CASE t {cases} ELSE text END AS translated
FROM (SELECT *, CAST(CASE WHEN page % 7 = 0 AND slot = 0 THEN 10 WHEN page % 5 = 0 AND slot = 4 THEN 760 WHEN type = 'formula' THEN 60 + 110 * ((slot + 1) % 3) ELSE 60 + 110 * (slot % 3) END AS DOUBLE) AS y0,
    CAST(CASE WHEN type = 'formula' THEN 20 ELSE least(100, 12 + 12 * floor(length(text) / 50)) END AS DOUBLE) AS h,
    'b_' || page || '_' || ord AS source_id
  FROM (SELECT *, CAST(floor(ord / 6) AS BIGINT) + 1 AS page, ord % 6 AS slot, (coalesce(doc_id, 0) * 3 + ord) % 12 AS t,
      CASE WHEN ord % 2 = 1 AND k = 4 THEN 'formula' WHEN ord % 2 = 1 AND k = 7 THEN 'section' WHEN ord % 2 = 1 AND k = 8 THEN 'caption' ELSE 'paragraph' END AS type
    FROM {parts}) a) b
""".replace("{cases}", _CASES)


def _cases(texts: dict[int, str], line: str) -> str:
    sql = lambda x: " || ".join(f"'{s}'" if i % 2 == 0 else s for i, s in enumerate(x.replace("{m}", "\0m\0").replace("{n}", "\0n\0").split("\0")) if s)
    return " ".join(f"WHEN {k} THEN {line + ' || ' if line else ''}{sql(x)}" for k, x in texts.items())


_LINES = "SELECT doc_id, no, line, (coalesce(doc_id, 0) * 7 + no) % 10 AS k, no % 9 + 1 AS m, coalesce(doc_id, 0) % 90 + 10 AS n FROM ({raw}) r WHERE line <> ''"
_PARTS = f"""SELECT doc_id, no * 2 + part AS ord, k, m, line, CASE WHEN part = 0 THEN CASE k {_cases(TAILS, "line")} ELSE line END ELSE CASE k {_cases(EXTRAS, "")} END END AS text FROM (SELECT * FROM ({{lines}}) l CROSS JOIN (VALUES (0), (1)) p(part)) c WHERE part = 0 OR k IN (2, 4, 6, 7, 8)"""

#: A common table expression ``b`` for DuckDB.
BLOCKS_SQL = "b AS (" + _LAID.replace("{parts}", "(" + _PARTS.replace("{lines}", _LINES.replace("{raw}", r"SELECT doc_id, CAST(i - 1 AS BIGINT) AS no, trim(regexp_replace(w[i], '[ \t\r]+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents) s, unnest(range(1, len(w) + 1)) u(i)")) + ") q") + ")"


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block: doc_id, ord, page, source_id, type, translate, geometry, text and a translation of it.
    Null texts have no blocks; null ids count as 0 in the rules."""
    # lines are squeezed before they become rows: Spark would do it once more for the filter
    raw = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))).alias("no", "line"))
    lines = raw.select("doc_id", F.col("no").cast("long").alias("no"), "line").where("line <> ''")
    number = F.coalesce("doc_id", F.lit(0))
    lines = lines.select("*", ((number * 7 + F.col("no")) % 10).alias("k"), (F.col("no") % 9 + 1).alias("m"), (number % 90 + 10).alias("n"))
    fill = lambda x: F.replace(F.replace(F.lit(x), F.lit("{m}"), F.col("m").cast("string")), F.lit("{n}"), F.col("n").cast("string"))
    text, extra = F.col("line"), F.lit(None).cast("string")
    for k, x in TAILS.items():
        text = F.when(F.col("k") == k, F.concat("line", fill(x))).otherwise(text)
    for k, x in EXTRAS.items():
        extra = F.when(F.col("k") == k, fill(x)).otherwise(extra)
    parts = lines.select("doc_id", "no", "k", "m", "line", F.posexplode(F.array(text, extra)).alias("part", "text")).where("text is not null")
    parts = parts.select("doc_id", (F.col("no") * 2 + F.col("part")).alias("ord"), "k", "m", "line", "text")
    return docs.sparkSession.sql(_LAID.replace("{parts}", "{parts} q"), parts=parts)
