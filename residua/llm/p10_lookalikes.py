"""Problem 10: one form for texts that look the same.

A text is first checked quickly: what is ASCII is in its final form, and in
other texts only segments around non-ASCII characters can change. Such a
segment, with the ASCII character before it as boundary context, is left as it
is where the quick-check property of the normal form holds and none of its
characters is an invisible mark, a blank or a look-alike; otherwise it is
decomposed, cleaned, mapped and composed again, and spliced into the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.session import written

# Letters of other alphabets and phonetic letters that are drawn like a Latin letter, for each alphabet
# the letters and, below them, the Latin ones.
ALPHABETS = (
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ", "ABEZHIKMNOPTYXovpcjCJ"),
    # Cyrillic
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴ", "ABESIJKMHOPCTYXYGQWIV"),
    ("аеѕіјорсухүһԁԛԝӏѵ", "aesijopcyxyhdqwlv"),
    # Armenian
    ("ՕՍՏօոսհցքզգյ", "OUSonuhgpqqj"),
    # Georgian, Tifinagh
    ("ჿⵔⵏⵝⴹ", "yOlXE"),
    # Coptic
    ("ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ", "BHIKMNOoPpCcTYX"),
    # Cherokee
    ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiyAJEWMHYGhZbRWVSLCPKdGB"),
    # Lisu
    ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
    # Deseret, Old Italic, Lycian, Carian
    ("𐐄𐐕𐐛𐐠𐐬𐐽𐑈", "OCLSocs"),
    ("𐌀𐌁𐌂𐌉𐌑𐌕𐌗", "ABCIMTX"),
    ("𐊂𐊆𐊒𐊕𐊖𐊗𐊠𐊡𐊢𐊫", "BEOPSTABCO"),
    # Latin phonetic letters and small capitals
    ("ɑɡɩɪıȷᴄᴏꜱᴜᴠᴡᴢʏ", "agiiijcosuvwzy"),
)
LOOKALIKES = {letter: latin for letters, latins in ALPHABETS for letter, latin in zip(letters, latins, strict=True)}
TABLE = str.maketrans(LOOKALIKES)
#: Format characters that show a sign of their own stay.
INVISIBLE = regex.compile(r"[[\p{Default_Ignorable_Code_Point}\p{Cf}]--[؀-؅۝܏࢐࢑࣢\U000110BD\U000110CD]]", regex.V1)
BLANK = regex.compile(r"[[\p{Zs}\p{Zl}\p{Zp}\u0085]--[ ]]", regex.V1)
SEGMENT = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
SPECIAL = regex.compile(r"[[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Zs}\p{Zl}\p{Zp}\u0085" + "".join(LOOKALIKES) + "]--[ ]]", regex.V1)


def settled(segment: str) -> str:
    """Canonical form of a segment that starts at a boundary."""
    if unicodedata.is_normalized("NFKC", segment) and not SPECIAL.search(segment):
        # accents on a look-alike letter come composed: look into the letters
        if not SPECIAL.search(unicodedata.normalize("NFKD", segment)):
            return segment
    plain = BLANK.sub(" ", INVISIBLE.sub("", segment))
    # some look-alikes decompose into letters that are none, others come out of a decomposition
    plain = unicodedata.normalize("NFKD", plain.translate(TABLE))
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", plain).translate(TABLE))


def one_form(text: str, known: dict[str, str] | None = None) -> str:
    """The form that all texts of the same look share; ``known`` keeps settled segments."""
    if text.isascii():
        return text
    known = {} if known is None else known

    def form(match) -> str:
        segment = match[0]
        if segment not in known:
            if len(known) > 100_000:
                known.clear()
            known[segment] = settled(segment)
        return known[segment]

    return SEGMENT.sub(form, text)


def canonical(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text hash, canonical text, changed) of every document with a key and a text.

    Empty texts have the empty form; null texts and keys are left out. Whole
    texts are brought to their form.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            form = [one_form(t, known) for t in texts]
            changed = [a != b for a, b in zip(form, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(form, pa.string()), pa.array(changed)], [key, "raw", "form", "changed"])

    rows = documents.select(F.col(key).cast("long").alias(key), F.sha2(column, 256).alias("raw"), F.col(column).alias("text")).where(f"{key} is not null and text is not null")
    return rows.mapInArrow(work, f"{key} long, raw string, form string, changed boolean")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def same_look(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents with different characters and one form, the smaller id first.

    The different texts of a form are paired first, and only then joined with
    their documents, so that work follows the result: a group of equal texts,
    however large, pairs nothing within itself.
    """
    rows = written(canonical(documents).select("doc_id", F.xxhash64("raw").alias("raw"), F.sha2("form", 256).alias("form")).distinct(), "forms")
    texts = rows.select("form", "raw").distinct()
    one, two = (texts.select("form", F.col("raw").alias(f"raw_{n}")) for n in "ab")
    pairs = one.join(two, "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    left, right = (rows.select(F.col("raw").alias(f"raw_{n}"), F.col("doc_id").alias(f"doc_{n}")) for n in "ab")
    both = pairs.join(left, "raw_a").join(right, "raw_b").where("doc_a <> doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b")).distinct()


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: SHA-256 of its form, whether the form differs, the smallest doc_id with that form and the number of documents and texts that have it."""
    rows = canonical(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "raw", "changed", F.sha2("form", 256).alias("form_sha256"))
    looks = rows.groupBy("form_sha256").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("documents"), F.countDistinct("raw").alias("texts"))
    return rows.join(looks, "form_sha256").select("doc_id", "form_sha256", "changed", "first_doc_id", "documents", "texts")


QUERIES = {"p10_found": p10_found, "p10_forms": p10_forms}


def plain_sql() -> str:
    """CTE plain(doc_id, text, form): every character on its own replaced by its decomposed plain form, then composed.

    The table of characters is made from the Unicode data, not from segments.
    """
    table = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if c in LOOKALIKES or unicodedata.decomposition(c) or INVISIBLE.match(c) or BLANK.match(c):
            bare = BLANK.sub(" ", INVISIBLE.sub("", c))
            table[code] = INVISIBLE.sub("", unicodedata.normalize("NFKD", bare.translate(TABLE))).translate(TABLE)
    codes = ", ".join(map(str, table))
    forms = ", ".join("'" + form.replace("'", "''") + "'" for form in table.values())
    return f"""m AS (SELECT unnest([{codes}]) AS code, unnest([{forms}]) AS r), d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT doc_id, i, substr(text, i::BIGINT, 1) AS c FROM d, unnest(generate_series(1, length(text))) AS u(i) WHERE strlen(text) > length(text)),
f AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)) AS form FROM x LEFT JOIN m ON m.code = unicode(c) GROUP BY doc_id),
plain AS MATERIALIZED (SELECT d.doc_id, d.text, coalesce(f.form, d.text) AS form FROM d LEFT JOIN f USING (doc_id))"""


#: Made when they are asked for.
ORACLE = {
    "p10_found": lambda: f"WITH {plain_sql()} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM plain a JOIN plain b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_forms": lambda: f"WITH {plain_sql()}, g AS (SELECT form, min(doc_id) AS first_doc_id, count(*) AS documents, count(DISTINCT text) AS texts FROM plain GROUP BY form) "
    "SELECT doc_id, sha256(form) AS form_sha256, form <> text AS changed, first_doc_id, documents, texts FROM plain JOIN g USING (form)",
}
