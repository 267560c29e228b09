r"""Fill-in-middle transformation by an Arrow-batched pandas UDF.

A text is cut into units, a word with the white space before it or white space at the end. The regex library finds them
one by one and only their end offsets are kept, in a compact array; two of these offsets slice the text into prefix,
middle and suffix. Seeds come from a hash of the row's id, so a row's output depends on nothing but its id and text, on
any partitioning and after any retry. restored() rebuilds the text from output and form: the first marker after a part
is the marker that ended it, since no part holds a marker and no marker can begin in a part and end in a marker.

One pass, no shuffle. A task holds one Arrow batch.

Defined results: a null or empty text has no units and is plain, its output the empty string; a null id is seeded as if
its digits were empty; very long texts are cut whole, four bytes of offsets a unit; repeated rows give equal rows; an
empty table gives no rows; extra columns are kept by transformed() unless they have the name of one of its results, then
the result stands in their place. ids are integers.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Units, markers, seed and shares in percent.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
CHANGED = 50
SUFFIX_FIRST = 80

_UNIT = regex.compile(UNIT)
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """The offsets, in code points, at which the units of a text end."""
    return array("I", (m.end() for m in _UNIT.finditer(text)))


def seeds(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a row's id."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def cut(key: str, text: str, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(key, seed)
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= changed:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (i, j))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED):
    """The UDF: (id as digits, text) to a struct of FIELDS."""

    @pandas_udf(FIELDS)
    def run(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [cut(k or "", t or "", changed, suffix_first, seed) for k, t in zip(key, text)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        for c in ("prefix_chars", "middle_chars"):
            out[c] = out[c].astype("Int64")
        return out.assign(output_sha256=[sha256(r[4]) for r in rows])

    return run


def restored(as_digest: bool = False):
    """The UDF: (output, form) to the exact text, or to its digest."""

    @pandas_udf("string")
    def run(output: pd.Series, form: pd.Series) -> pd.Series:
        texts = (rebuilt(o, f) for o, f in zip(output, form))
        return pd.Series([sha256(t) if as_digest else t for t in texts], dtype=object)

    return run


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output and output_sha256."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    made = fill_in_middle(**how)(F.col(f"`{key}`").cast("long").cast("string"), F.col(f"`{text}`"))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])
    out = docs.select(held.alias("_row"), made.alias("_made"))
    return out.select("_row.*", *[F.col("_made")[c].alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = transformed(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored(as_digest=True)("output", "form").alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     s AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM s),
     p AS (SELECT *, CASE WHEN i = 0 THEN '' ELSE array_to_string(u[1:i], '') END AS prefix, CASE WHEN i = j THEN '' ELSE array_to_string(u[i + 1:j], '') END AS middle,
                  CASE WHEN j = n THEN '' ELSE array_to_string(u[j + 1:n], '') END AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
