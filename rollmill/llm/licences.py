"""Licence scan by canonical digest: whole texts, normalised, hash-joined to known licences.

Everything is DataFrame functions; there is no Python on the executors. Normalisation: ASCII
letters to lower case, typographic quotes and dashes to spaces, copyright and "all rights
reserved" lines away, every run of ASCII punctuation and white space to one space, then
equivalent spellings to one form. The SHA-256 of what is left is the document's digest. The join
to the known texts takes the digest of the text without its head: lines at its start that are a
licence's title or any copyright line.

Nulls: a null text has a null digest and no licence. Empty texts, and texts of punctuation alone,
have the digest of the empty string, which no known licence has. Repeated rows and ties give a
row each (known texts with equal digests: the least licence id). Empty tables give empty results.
Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm import licence_texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic signs that count as punctuation.
SIGNS = "“”‘’«»–—…•·"
COPYRIGHT_LINE = r"(^|\n)[ \t\r#*/;%-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\])|(\(c\)|©)[ \t]*[0-9]{4}|all rights reserved)[^\n]*"
_TITLE = r"""(?:the[ \t]+)?(?:(?:mit|isc|zlib|(?:new|modified|revised|simplified|original)[ \t]+bsd|bsd)(?:[ \t-]+(?:zero|[0-4])[ \t-]?clause)?(?:[ \t]+["“]?(?:new|simplified|revised|freebsd)["”]?(?:[ \t]+or[ \t]+["“]?(?:revised|freebsd)["”]?)?)?[ \t]+licen[sc]e|mit[ \t]+no[ \t]+attribution(?:[ \t]+licen[sc]e)?|(?:mit-0|0bsd|zero-clause[ \t]+bsd)(?:[ \t]+licen[sc]e)?)(?:[ \t]*\([a-z0-9 \t-]+\))?[ \t.:*=#-]*(?=[\r\n]|$)"""
#: Title and copyright lines at the start of a text; further down, "copyright" may begin a wrapped line of the licence itself.
HEAD = rf"(?i)^(?:[\s#*/;%=-]*+(?:{_TITLE}|(?:(?:portions[ \t]+)?copyright\b|\(c\)|©|all rights reserved)[^\n]*+))++"
PUNCTUATION = r"[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Equivalent spellings, as stems: British to American, and compounds to one word.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasis", "emphasiz"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("https", "http"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labell", "label"),
    ("labour", "labor"),
    ("licenc", "licens"),
    ("maximis", "maximiz"),
    ("modell", "model"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimis", "optimiz"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("practis", "practic"),
    ("programme ", "program "),
    ("realis", "realiz"),
    ("recognis", "recogniz"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
)


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER + SIGNS, LOWER + " " * len(SIGNS))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def known_licences(spark: SparkSession) -> DataFrame:
    """licence_id, text of the licences this package knows."""
    rows = F.array(*[F.struct(F.lit(k).alias("licence_id"), F.lit(v).alias("text")) for k, v in licence_texts.TEXTS.items()])
    return spark.range(1).select(F.inline(rows))


def known_digests(licences: DataFrame) -> DataFrame:
    """licence_id, digest of each text without its head."""
    return licences.select("licence_id", F.regexp_replace("text", HEAD, "").alias("text")).select("licence_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))


def published_digests(spark: SparkSession) -> DataFrame:
    """licence_id, digest of the long licences, as they are published."""
    rows = F.array(*[F.struct(F.lit(k).alias("licence_id"), F.lit(d).alias("digest")) for k, digests in licence_texts.DIGESTS.items() for d in digests])
    return spark.range(1).select(F.inline(rows))


def scan_licences(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, canonical_sha256, licence_id (null: not the text of a known licence).

    ``licences``: licence_id and text, of any size (Spark picks the join by its statistics); by default the known ones.
    """
    known = known_digests(known_licences(docs.sparkSession)).unionAll(published_digests(docs.sparkSession)) if licences is None else known_digests(licences)
    digests = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    bare = F.regexp_replace(F.col(text_col), HEAD, "")
    scanned = docs.select(F.col(id_col), F.col(text_col).alias("__text"), bare.alias("__bare"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    same = F.octet_length("__text") == F.octet_length("__bare")  # most texts have no such head
    scanned = scanned.select(id_col, "canonical_sha256", F.when(same, F.col("canonical_sha256")).otherwise(F.sha2(canonical(F.col("__bare")), 256)).alias("digest"))
    return scanned.join(digests, "digest", "left").select(id_col, "canonical_sha256", "licence_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """``canonical`` as DuckDB SQL over an expression."""
    out = f"translate({text}, {_quoted(UPPER + SIGNS)}, {_quoted(LOWER + ' ' * len(SIGNS))})"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"trim(regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def bare_sql(text: str) -> str:
    """A text without its head, as DuckDB SQL. Its expressions have no looking ahead and no possessive steps, so a title takes the end of its line with it, which makes no difference once punctuation and white space are one space."""
    head = HEAD.replace("*+", "*").replace("++", "+").replace(r"(?=[\r\n]|$)", r"(?:[\r\n]|$)").replace(r"[\s#", r"[\s\x0B#")
    return f"regexp_replace({text}, {_quoted(head)}, '')"


def _scan_sql(known: str) -> str:
    """The scan for the digests (digest, licence_id) of a query."""
    return (
        f"WITH known AS (SELECT digest AS known_digest, min(licence_id) AS licence_id FROM ({known}) WHERE digest <> sha256('') GROUP BY 1), "
        f"scanned AS (SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_sha256, sha256({canonical_sql(bare_sql('text'))}) AS digest FROM documents) "
        "SELECT doc_id, canonical_sha256, licence_id FROM scanned LEFT JOIN known ON digest = known_digest"
    )


def scan_sql() -> str:
    texts = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licence_texts.TEXTS.items())
    digests = ", ".join(f"({_quoted(d)}, {_quoted(k)})" for k, ds in licence_texts.DIGESTS.items() for d in ds)
    return _scan_sql(f"SELECT sha256({canonical_sql(bare_sql('t'))}) AS digest, licence_id FROM (VALUES {texts}) AS k(licence_id, t) UNION ALL SELECT * FROM (VALUES {digests}) AS d(digest, licence_id)")


#: What a disguise puts before a text.
DISGUISE = "The MIT License (MIT)\n\n# Copyright (c) 2020 Somebody\n"


def disguised(docs: DataFrame) -> DataFrame:
    """Every twentieth document by its id, in capitals, with another quote and a licence's head, as a set of licences named by id."""
    text = F.concat(F.lit(DISGUISE), F.translate("text", LOWER + '"', UPPER + "“"))
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("licence_id"), text.alias("text"))


def disguised_sql() -> str:
    text = f"{_quoted(DISGUISE)} || translate(text, {_quoted(LOWER + chr(34))}, {_quoted(UPPER + '“')})"
    return _scan_sql(f"SELECT sha256({canonical_sql(bare_sql(text))}) AS digest, doc_id::VARCHAR AS licence_id FROM documents WHERE doc_id % 20 = 0")
