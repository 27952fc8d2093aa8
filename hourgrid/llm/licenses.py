"""Licence scans by canonical digests (DataFrame functions only)."""

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import staged, table

#: Up to so many digests of the registry (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000

# First lines that a copy may lack, and notices that stand for a licence.
TITLES = ("MIT License", "ISC License", "BSD 2-Clause License", "BSD 3-Clause License", "zlib License")
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0."],
}


def _registry() -> dict[str, list[str]]:
    """The licences' whole texts (license_texts/*.txt, with and without the title line), notices, and SPDX tags."""
    known = {k: list(v) for k, v in NOTICES.items()}
    for file in files("hourgrid.llm").joinpath("license_texts").iterdir():
        if file.name.endswith(".txt"):
            text = file.read_text()
            title, _, rest = text.partition("\n")
            known.setdefault(file.name.removesuffix(".txt"), []).extend([text, rest] if title in TITLES else [text])
    return {k: [*v, f"SPDX-License-Identifier: {k}"] for k, v in sorted(known.items())}


LICENSES = _registry()
# Spellings that count as equal, in lower case.
SPELLINGS = (("licence", "license"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("https:", "http:"), ("&", " and "))

_COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
_PUNCTUATION = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, blanks for punctuation; lines stay."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, _PUNCTUATION, " ")


def digest_of_whole(canon: Column) -> Column:
    """sha256 of a whole canonical text, however its lines are broken; null without words."""
    flat = F.trim(F.regexp_replace(canon, "[ \n]+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def known_digests(spark: SparkSession, known: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license_id), one row for each distinct digest of a registry: texts by licence, or a table
    (license_id, text). A text that two licences share counts as the first by name."""
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame([(k, t) for k, texts in (known or LICENSES).items() for t in texts], "license_id string, text string")
    digests = known.select(digest_of_whole(canonical(F.col("text"))).alias("digest"), "license_id").where("digest IS NOT NULL")
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] | DataFrame | None = None) -> DataFrame:
    """Each document with the digest of its canonical text, the licence whose whole text it is, and the licences
    whose whole text is one of its lines.

    Digests of whole documents and of their lines are hash-joined to those of the registry, which are broadcast
    up to BROADCAST_DIGESTS. What a document's lines are found to be belongs to its canonical text and is joined
    back by its digest. Rows are kept as they are, repeated or not; null texts and texts without a word have a null
    digest and no licence. An empty table gives an empty result; other columns are not looked at."""
    known_rows = staged(known_digests(docs.sparkSession, known))
    if known_rows.count() <= BROADCAST_DIGESTS:
        known_rows = F.broadcast(known_rows)
    lines = F.filter(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = staged(
        docs.select("doc_id", canonical(F.col("text")).alias("canon"))
        .select("doc_id", digest_of_whole(F.col("canon")).alias("digest"), F.array_distinct(F.transform(lines, lambda x: F.sha2(x, 256))).alias("lines"))
        # a key of its own for a text without a digest, so that these do not meet in one task
        .withColumn("key", F.coalesce("digest", F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    found = rows.select("key", F.explode("lines").alias("digest")).join(known_rows, "digest")
    notices = found.groupBy("key").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))  # as many as the registry has
    return (
        rows.drop("lines").join(known_rows, "digest", "left").join(notices, "key", "left")
        .select("doc_id", "digest", F.col("license_id").alias("whole_license"), F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"),
                F.coalesce(F.size("notices"), F.lit(0)).alias("n_notices"), (F.col("license_id").isNotNull() | F.col("notices").isNotNull()).alias("licensed"))
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents; null texts have none."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '{_PUNCTUATION}', ' ', 'g')"


def _known_sql(known: dict[str, list[str]]) -> str:
    return ", ".join("('" + k + "', '" + t.replace("'", "''") + "')" for k, texts in known.items() for t in texts)


SQL = f"""
WITH known AS (
  SELECT sha256(flat) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, trim(regexp_replace({_canonical_sql("text")}, '[ \n]+', ' ', 'g')) AS flat FROM (VALUES {_known_sql(LICENSES)}) v(license_id, text))
  WHERE flat <> '' GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_canonical_sql("text")} AS canon FROM documents),
whole AS (SELECT rid, doc_id, nullif(trim(regexp_replace(canon, '[ \n]+', ' ', 'g')), '') AS flat, canon FROM docs),
lines AS (SELECT DISTINCT rid, license_id FROM (SELECT rid, unnest(string_split(canon, chr(10))) AS line FROM docs) l JOIN known ON sha256(trim(line)) = digest),
notes AS (SELECT rid, string_agg(license_id, ',' ORDER BY license_id) AS notices, count(*)::INTEGER AS n_notices FROM lines GROUP BY rid)
SELECT doc_id, CASE WHEN flat IS NOT NULL THEN sha256(flat) END AS digest, license_id AS whole_license, coalesce(notices, '') AS notices,
  coalesce(n_notices, 0) AS n_notices, license_id IS NOT NULL OR n_notices IS NOT NULL AS licensed
FROM whole LEFT JOIN notes USING (rid) LEFT JOIN known ON digest = sha256(flat)
"""
