"""Masking of people and credentials, idempotent, as a chain of replacements."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes that are masked.
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?U)(?<![\w-])(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?![\w-])"
SECRET_WORD = r"(?iU)(?<!\[)\b(password|passcode|passwd|pwd|credential|secret|api[ _-]?key|access[ _-]?token|token)s?\b([^\n\"“”']{0,25}?)([\"“'])([^\"”'\n]{4,})([\"”'])"
SECRET_SHAPE = r"(?U)(?<![\w/@.])(?=[^\s\"”'/]*[A-Za-z])(?=[^\s\"”'/]*\d)(?=[^\s\"”'/]*[!#$^&*])[^\s\"”'/@]{8,}"
EVERYDAY_ZIPF, EVERYDAY_SHARE = 4.0, 0.5


def scrub_named_secrets(c: Column) -> Column:
    """Quoted values behind a word that announces a credential."""
    return F.regexp_replace(c, SECRET_WORD, r"$1$2$3[secret]$5")


def scrub_secrets(c: Column) -> Column:
    return F.regexp_replace(scrub_named_secrets(c), SECRET_SHAPE, "[secret]")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[email]")


def mask_contacts(c: Column) -> Column:
    return F.regexp_replace(mask_emails(scrub_secrets(c)), PHONE, "[phone]")


def _any(words: Iterable[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def mask_people(c: Column, names: Iterable[str] = (), everyday: Iterable[str] = ()) -> Column:
    """Names in any case; names that are everyday words only where clearly a name or written as one.

    The dictionaries are driver-side sets of the handles of one export; their size is that of the chat's membership.
    """
    names, everyday = set(names), set(everyday)
    if names:
        c = F.regexp_replace(c, rf"(?iU)(?<!\w)(?:{_any(names)})(?!\w)", "[person]")
    if everyday:
        c = F.regexp_replace(c, rf"(?iU)(?<=@)(?:{_any(everyday)})(?!\w)|(?<![\w@])(?:{_any(everyday)})(?=\s*:)", "[person]")
        shown = {w for w in everyday if w != w.lower()}
        if shown:
            c = F.regexp_replace(c, rf"(?U)(?<!\w)(?:{_any(shown | {w.upper() for w in shown})})(?!\w)", "[person]")
    return c


def mask(c: Column, names: Iterable[str] = (), everyday: Iterable[str] = (), found: Iterable[str] = ()) -> Column:
    return mask_people(mask_people(mask_contacts(c), found), names, everyday)


def lowercase_share(texts: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """word, lower, uses: how often each of `words` (column word) is written in lower case."""
    used = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("([A-Za-z]+)"), F.lit(1))).alias("t"))
    return used.withColumn("word", F.lower("t")).join(words.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").groupBy("word").agg(F.count_if(F.col("t") == F.col("word")).alias("lower"), F.count("*").alias("uses"))


def everyday_words(handles: DataFrame, zipf: DataFrame, share: DataFrame) -> DataFrame:
    """The handles (column word) that are common in the language (word, zipf) and mostly lower case in use."""
    return handles.join(zipf, F.lower(handles["word"]) == zipf["word"]).where(F.col("zipf") >= EVERYDAY_ZIPF).select(handles["word"]).join(share.withColumnRenamed("word", "w"), F.lower("word") == F.col("w")).where(F.col("lower") >= EVERYDAY_SHARE * F.col("uses")).select("word")


def handles(events: DataFrame, agents: DataFrame) -> DataFrame:
    """word: human handles named in chat events (JSON column data), without the names of agents or words of them."""
    field = lambda kind, name: events.where(F.col("action_type") == kind).select(F.get_json_object("data", f"$.{name}").alias("word"))
    said = field("USER_TALK", "speakerName").unionByName(field("USER_NAME_CHANGE", "newName")).unionByName(field("USER_NAME_CHANGE", "oldName"))
    own = agents.select(F.explode(F.concat(F.array(F.lower("name")), F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("own"))
    said = said.select(F.trim("word").alias("word")).where((F.char_length("word") >= 3) & F.col("word").rlike("[A-Za-z]{2}")).distinct()
    return said.join(own.distinct(), F.lower("word") == F.col("own"), "left_anti")


def leaking(c: Column, names: Iterable[str] = ()) -> Column:
    """Whether a text still holds something that mask() would change."""
    return F.coalesce(c != mask(c, names), F.lit(False))


def leaks(texts: DataFrame, text: str, names: Iterable[str] = ()) -> DataFrame:
    """Rows whose text still leaks."""
    return texts.where(leaking(F.col(text), names))


def mask_nested(df: DataFrame, keep: Iterable[str] = (), names: Iterable[str] = ()) -> DataFrame:
    """df with every string masked, in structs and arrays of any depth, but in fields named in `keep`."""
    from pyspark.sql.types import ArrayType, DataType, StringType, StructType

    kept = set(keep)

    def deep(c: Column, kind: DataType, name: str) -> Column:
        if name in kept:
            return c
        if isinstance(kind, StringType):
            return mask(c, names)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: deep(x, kind.elementType, name))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[deep(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[deep(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])
