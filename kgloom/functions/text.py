"""Text functions as column expressions; what Spark lacks (NFKC, seeded vectors) as Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType, StringType

#: White space as Unicode has it; the regular expressions of the JVM know only ASCII's by default.
WS = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# What is taken out of texts, in order.
CODE_BLOCK = "(?s)```.*?```"
TILDE_BLOCK = "(?s)~~~.*?~~~"
INLINE_CODE = "`[^`\\n]+`"
URL = "https?://[^\\s]+|www\\.[^\\s]+"
HTML_TAG = "<[^>]+>"
CITATIONS = ["(?i)cite\\s*turn[0-9]+search[0-9]+", "(?i)turn[0-9]+search[0-9]+", "(?i)cite", "\\[[0-9]+†source\\]", "【.*?】", "\\[.*?†.*?\\]", "(?i)\\bcite\\b"]
RULE = "(?m)^\\s*(?:-{3,}|_{3,}|\\*{3,})\\s*$"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{1F1E6}-\\x{1F1FF}]"
PUNCTUATION = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~，。！？；：、《》「」『』（）【】…·]"

# Frequent words that carry no topic.
STOP_WORDS = "a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in into is it its just me more most my no nor not of on only or our out over own she should so some such than that the their them then there these they this those to too under until up very was we were what when where which while who whom why will with would you your".split()


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@arrow_udf(StringType())
def nfkc(values):
    """Unicode normalisation form KC; null stays null."""
    import unicodedata

    import pyarrow as pa

    return pa.array([None if v is None else v if v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def squeezed(value: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_as_column(value), f"{WS}+", " "))


def without_citations(value: Column | str) -> Column:
    """Without the marks that chat exports leave for citations; the letters ``cite`` go wherever they stand."""
    out = _as_column(value)
    for pattern in CITATIONS:
        out = F.regexp_replace(out, pattern, " ")
    return out


def cleaned(value: Column | str, lower: bool = True, code: bool = True, urls: bool = True, html: bool = False, citations: bool = False, unicode: bool = True) -> Column:
    """Common cleaning: NFKC, then without tags, fenced code, links and citations, lower case, squeezed; null gives ''."""
    out = F.coalesce(_as_column(value), F.lit(""))
    out = nfkc(out) if unicode else out
    for wanted, pattern in ((html, HTML_TAG), (code, CODE_BLOCK), (urls, URL)):
        out = F.regexp_replace(out, pattern, " ") if wanted else out
    out = without_citations(out) if citations else out
    return squeezed(F.lower(out) if lower else out)


def preprocessed(value: Column | str, punctuation: bool = False, unicode: bool = True, cjk: bool = False) -> Column:
    """:func:`cleaned` with everything on, and without inline code, rules and emoji; ``cjk`` separates Chinese characters in pairs."""
    out = cleaned(value, html=True, citations=True, unicode=unicode)
    for pattern in (TILDE_BLOCK, INLINE_CODE, RULE):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, EMOJI, "")
    if cjk:
        out = F.regexp_replace(out, "([\\u4e00-\\u9fff]{2})(?=[\\u4e00-\\u9fff])", "$1 ")
    return squeezed(F.regexp_replace(out, PUNCTUATION, " ") if punctuation else out)


def without_markdown(value: Column | str) -> Column:
    """Plain text of Markdown: no callouts, images or code; links and emphasis by their words; squeezed."""
    steps = [
        ("(?m)^>\\s*\\[!.*?\\].*$", ""), ("!\\[.*?\\]\\(.*?\\)", ""), (CODE_BLOCK, " "), ("`[^`]+`", " "), ("\\[\\[[^\\]|]*\\|([^\\]]+)\\]\\]", "$1"), ("\\[\\[([^\\]]+)\\]\\]", "$1"),
        ("\\[([^\\]]+)\\]\\([^\\)]+\\)", "$1"), ("(?m)^[\\-\\*_]{3,}\\s*$", ""), ("(?m)^>\\s*", ""), ("\\*\\*([^\\*]+)\\*\\*", "$1"), ("\\*([^\\*]+)\\*", "$1"), ("__([^_]+)__", "$1"), ("_([^_]+)_", "$1"),
    ]
    out = F.coalesce(_as_column(value), F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return squeezed(out)


def plain_name(value: Column | str) -> Column:
    """A name for comparison: lower case, squeezed."""
    return F.lower(squeezed(value))


def contains_chinese(value: Column | str) -> Column:
    return _as_column(value).rlike("[\\u4e00-\\u9fff]")


def contains_latin(value: Column | str) -> Column:
    return _as_column(value).rlike("[A-Za-z]")


def only_chinese(value: Column | str) -> Column:
    return _as_column(value).rlike("^[\\u4e00-\\u9fff]+$")


def without_outer_punctuation(value: Column | str) -> Column:
    inner = "[^\\p{L}\\p{N}_]"
    return F.regexp_replace(_as_column(value), f"^{inner}+|{inner}+$", "")


def topic_tokens(value: Column | str, stop_words: Sequence[str] = STOP_WORDS, longest: int = 48) -> Column:
    """Tokens that may name a topic: split at white space, outer punctuation off, without stop words, paths, code marks,
    single characters (but x, y, z) and tokens of fewer than three tenths letters or digits."""
    raw = F.transform(F.split(F.lower(squeezed(value)), " "), without_outer_punctuation)
    plain = lambda t: F.length(F.regexp_replace(t, "[^\\p{L}\\p{N}]", ""))
    keep = lambda t: (
        (F.length(t) > 0) & (F.length(t) <= longest) & ((F.length(t) > 1) | t.isin("x", "y", "z") | t.rlike("[\\u4e00-\\u9fff]")) & ~t.isin(*stop_words)
        & ~t.rlike("[\\\\{}|^=`]|/.*/|::") & (plain(t) >= 0.3 * F.length(t))
    )
    return F.filter(raw, keep)


def grams(tokens: Column, most: int = 3) -> Column:
    """All runs of one to ``most`` tokens, joined by spaces."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(0)), F.lit(1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.flatten(F.array(*[F.when(F.size(tokens) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Share of common elements of two arrays seen as sets; ``empty`` where both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def epoch_seconds(value: Column | str) -> Column:
    """Whole seconds of a number or numeric text, else null."""
    return F.floor(_as_column(value).cast("string").try_cast("double")).try_cast("bigint")


def epoch_of_any_unit(value: Column | str, now: int) -> Column:
    """Seconds, milliseconds being told by their size; ``now`` where there is no number."""
    number = _as_column(value).cast("string").try_cast("double")
    return F.coalesce(F.floor(F.when(number > 1e10, number / 1000).otherwise(number)).try_cast("bigint"), F.lit(now).cast("bigint"))


def epoch_of_date(value: Column | str) -> Column:
    """Epoch seconds of the first 19 characters as a date in one of four formats (session time zone), else null."""
    text = F.substring(_as_column(value), 1, 19)
    return F.unix_seconds(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")]))


def json_is_whole(value: Column | str) -> Column:
    """Whether a JSON text ends with a bracket and closes as many as it opens."""
    text = F.trim(_as_column(value))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.coalesce(text.rlike("[}\\]]$") & (count("{") == count("}")) & (count("[") == count("]")), F.lit(False))


def cluster_number(value: Column | str) -> Column:
    return F.regexp_extract(_as_column(value), "([0-9]+)$", 1).try_cast("int")


def token_estimate(value: Column | str) -> Column:
    """About four characters a token."""
    return F.ceil(F.length(F.coalesce(_as_column(value), F.lit(""))) / 4).cast("int")


def seeded_vector(dimension: int = 384, normalised: bool = True):
    """An Arrow function from text to a vector that only depends on the text, standing in for a model; '' and null give zeros."""

    @arrow_udf(ArrayType(FloatType()))
    def embed(values):
        import hashlib

        import numpy as np
        import pyarrow as pa

        out = []
        for text in values.to_pylist():
            if not text:
                out.append(np.zeros(dimension, np.float32))
                continue
            vector = np.random.default_rng(int(hashlib.sha1(text.encode()).hexdigest()[:16], 16)).standard_normal(dimension).astype(np.float32)
            out.append(vector / np.linalg.norm(vector) if normalised else vector)
        return pa.array(out, pa.list_(pa.float32()))

    return embed
