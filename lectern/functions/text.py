"""Scalar text functions as Column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 48 words the retrieval tokenizer ignores.
STOP_WORDS = (
    "a an the and or of to in on at is are was were be been what who how why where when which "
    "does do did have has had it this that with for from as i you we they he she its my me by "
    "about please"
).split()

# Single-byte words never reach the index; listing them keeps the filter one array_except.
_SHORT_WORDS = [""] + [chr(c) for c in range(ord("a"), ord("z") + 1)] + [str(d) for d in range(10)]

WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"
CJK = r"[\x{3400}-\x{9fff}]"

# Titles that mark a chapter as noise, alone or before a colon.
NOISE_TITLES = (
    "contents",
    "table of contents",
    "目录",
    "advertisement",
    "advertisements",
    "sponsored message",
    "about the publisher",
)


def normalise_whitespace(col: Column) -> Column:
    """Collapse runs of Unicode white space to one space and trim.

    The pattern only matches what has to change (two or more spaces, or one
    non-space blank), so ordinary text passes without a replacement per word.
    """
    return F.trim(F.regexp_replace(col, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def stable_block_id(href: Column, order: Column, fp: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", href, order.cast("string"), fp), 256), 1, 32)


def chapter_id(spine_index: Column) -> Column:
    return F.format_string("chapter_%03d", spine_index.cast("long") + 1)


def chapter_number(chapter_id_col: Column) -> Column:
    """Inverse of chapter_id as written in ids (1-based); null when malformed."""
    digits = F.regexp_extract(chapter_id_col, r"^chapter_\+?([0-9]+)$", 1)
    return digits.try_cast("long")


def is_noise_title(title: Column, titles: tuple[str, ...] = NOISE_TITLES) -> Column:
    return F.substring_index(F.lower(normalise_whitespace(title)), ":", 1).isin(*titles)


def safe_name(value: Column) -> Column:
    """Letters, digits, '-' and '_' stay, everything else becomes '-'; 80 characters."""
    dashed = F.regexp_replace(value, r"[^\p{IsAlphabetic}\p{N}_-]", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 80)


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))


def strip_markup(value: Column) -> Column:
    """Drop tags (an unclosed tag swallows the rest) and collapse white space."""
    without = F.regexp_replace(value, r"<[^>]*(>|\z)", "")
    return normalise_whitespace(F.regexp_replace(without, ">", ""))


def decode_entities(value: Column) -> Column:
    """The five XML entities, ``&amp;`` first."""
    out = value
    # Entity and the character it stands for, in decoding order.
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def attribute(tag: Column, name: str) -> Column:
    """Quoted value of an attribute, entities decoded; null when absent or unquoted."""
    found = F.regexp_extract(tag, rf"(?s)^.*?{name}=(?:(?:'([^']*)')|(?:\"([^\"]*)\"))", 0)
    quote = F.regexp_extract(tag, rf"(?s)^(?:(?!{name}=).)*{name}=(['\"])", 1)
    single = F.regexp_extract(tag, rf"(?s)^(?:(?!{name}=).)*{name}='([^']*)'", 1)
    double = F.regexp_extract(tag, rf"(?s)^(?:(?!{name}=).)*{name}=\"([^\"]*)\"", 1)
    value = F.when(quote == "'", single).when(quote == '"', double)
    return F.when(found != "", decode_entities(value))


def split_words(text: Column) -> Column:
    """Lower-cased words in order, duplicates kept, pieces may be empty.

    Lower-casing the whole text at once differs from lower-casing word by word
    only around dotted capital I and capital sigma, so those texts take the
    per-word path.
    """
    whole = F.split(F.lower(text), WORD_BREAK)
    by_word = F.transform(F.split(text, WORD_BREAK), F.lower)
    return F.when(text.rlike("[İΣ]"), by_word).otherwise(whole)


def query_terms(text: Column) -> Column:
    """Retrieval terms as a distinct array.

    Words of two or more bytes that are not stop words; a word with any
    character in U+3400..U+9FFF gives its adjacent character pairs instead.
    """
    ignored = F.array(*[F.lit(w) for w in STOP_WORDS + _SHORT_WORDS])
    words = split_words(text)
    plain = F.array_except(words, ignored)

    def pairs(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.char_length(word) - 1),
            lambda i: F.substring(word, i, F.lit(2)),
        )

    with_pairs = F.array_distinct(
        F.flatten(
            F.transform(
                plain,
                lambda w: F.when(
                    w.rlike(CJK),
                    F.when(F.char_length(w) > 1, pairs(w)).otherwise(F.array().cast("array<string>")),
                ).otherwise(F.array(w)),
            )
        )
    )
    return F.when(text.rlike(CJK), with_pairs).otherwise(plain)


def plain_terms(text: Column) -> Column:
    """Reflection terms: distinct words of two or more characters, stop words kept.

    The length rule looks at the word before lower-casing.
    """
    return F.array_distinct(
        F.transform(F.filter(F.split(text, WORD_BREAK), lambda w: F.char_length(w) > 1), F.lower)
    )


def clip(text: Column, n: Column | int) -> Column:
    """First n code points; n may be zero."""
    length = n if isinstance(n, Column) else F.lit(n)
    return F.substring(text, F.lit(1), length.cast("int"))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def href_path(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def href_fragment(href: Column) -> Column:
    """Text after the first '#', null when there is none."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substring(href, at + 1, F.length(href)))


def operation_name(method: Column, target: Column) -> Column:
    path = F.substring_index(target, "?", 1)
    return (
        F.when(path.endswith("/explain"), "explain")
        .when(path.endswith("/ask"), "ask")
        .when(path.endswith("/reflect"), "reflect")
        .when((method == "POST") & (path == "/v1/books"), "compile")
        .otherwise(F.concat_ws(" ", F.lower(method), path))
    )


def artifact_hash(*cols: Column) -> Column:
    """Hash of the canonical JSON of the given columns."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
