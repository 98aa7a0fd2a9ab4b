"""Text, hash and vector expressions as Columns, on the JVM side; only the hashing embedder is Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Whitespace as Python's str methods see it, without and with the line feed.
BLANK = r"[ \t\x0B\f\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What a log message must not show.
CREDENTIAL = r"(?i)\b(authorization|api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*[^\s,}]+|\bBearer\s+[^\s,}]+"
#: Wordings of a spent daily allowance.
DAILY = r"(?i)per day|daily|\bRPD\b|\bTPD\b|PerDay"
DOC_ID, CHUNK_ID = 32, 16
_WORD = re.compile(r"\w+")


def _nfc(text: Column) -> Column:
    """Unicode NFC by ICU, which Spark ships for its collations."""
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))


def normalize_text(text: Column) -> Column:
    """Line ends as LF, then Unicode NFC. Texts that hold nothing from U+0300 on are in that form already, and are passed over."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(lines.rlike(r"[^\x00-\x{2FF}]"), _nfc(lines)).otherwise(lines)


def plain_words(text: str | None) -> list[str]:
    """words() of a Python string."""
    return _WORD.findall(unicodedata.normalize("NFC", text or "").lower())


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(normalize_text(text), 256), 1, DOC_ID)


def stable_doc_id(uri: Column) -> Column:
    return content_hash(uri)


def chunk_id(doc_id: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", doc_id.cast("string"), ordinal.cast("string"), normalize_text(text)), 256), 1, CHUNK_ID)


def fingerprint(text: Column) -> Column:
    """Key of the embedding cache."""
    return F.sha2(normalize_text(text), 256)


def clean_text(text: Column) -> Column:
    """Normalised text without trailing blanks, with one empty line at most in a row and none at the ends."""
    trimmed = F.regexp_replace(normalize_text(text), BLANK + r"+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def heuristic_tokens(text: Column) -> Column:
    """A token for every four code points, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.array_remove(F.split(F.lower(normalize_text(text)), r"[^\p{L}\p{N}_]+"), "")


def match_terms(text: Column) -> Column:
    """Distinct quoted terms joined by OR; null without terms."""
    terms = F.array_distinct(words(text))
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def split_blanks(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def normalize_answer(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(text), r"""[!-/:-@\[-`{-~]""", "")
    return split_blanks(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, CREDENTIAL, "[REDACTED]")


def daily_quota(message: Column) -> Column:
    return message.rlike(DAILY)


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After value; null unless a number of zero or more."""
    seconds = F.expr("null").cast("double") if value is None else F.trim(value).try_cast("double")
    return F.when((seconds >= 0) & ~F.isnan(seconds), seconds)


def glob_regex(pattern: str) -> str:
    """A glob over whole paths as a regular expression: ** crosses folders, * and ? do not."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[i]) or re.escape(pattern[i]))
            i += 1
    return rf"(?s)\A{''.join(out)}\z"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def token_slot(token: Column, dim: int) -> Column:
    """A token's component in the hashing embedder."""
    return (F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of token slots as a unit vector: an embedder without a model. Zero for texts without tokens."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts = np.zeros(dim)
            for token in unicodedata.normalize("NFC", (t or "").replace("\r\n", "\n").replace("\r", "\n")).lower().split():
                counts[int.from_bytes(hashlib.sha1(token.encode()).digest()[:4], "big") % dim] += 1
            norm = np.sqrt((counts * counts).sum())
            out.append(counts / norm if norm else counts)
        return pd.Series(out)

    return embed(text)
