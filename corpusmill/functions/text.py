"""Text functions: every one takes and returns Columns, so they stay inside generated JVM code."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import fixed

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BLANK = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


SLICE_ROWS = 64


def composed(texts: pa.Array) -> pa.Array:
    """NFKC of every text; only the texts of a slice become Python strings at once."""
    done = [pa.array([], pa.string())]
    for start in range(0, len(texts), SLICE_ROWS):
        plain = texts.slice(start, SLICE_ROWS).to_pylist()
        done.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in plain], pa.string()))
    return pa.concat_arrays(done)


@F.arrow_udf(T.StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return composed(texts)


def compatibility_form(c: Column) -> Column:
    """NFKC. Only rows holding a non-ASCII character carry text to the Python side."""
    return F.coalesce(_compose(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


# ASCII controls but tab and line ends, line and paragraph separators, and two characters without width.
UNSEEN = r"[\p{Cntrl}\p{Zl}\p{Zp}\x{200B}\x{FEFF}&&[^\t\n\r]]"


def normalize_text(c: Column, nfkc: bool = True) -> Column:
    """Compatibility form, plain spaces, no unseen characters, only lines with something on them."""
    seen = F.regexp_replace(compatibility_form(c) if nfkc else c, UNSEEN, "")
    lines = F.split(F.regexp_replace(seen, r"[ \t\x{A0}]+", " "), "\n")
    return F.array_join(F.filter(lines, lambda line: line.rlike(rf"[^{BLANK[1:]}")), "\n")


def _ranges(pairs: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in pairs)


KEYCAP_PATTERN = r"[0-9#*]\x{FE0F}?\x{20E3}"
EMOJI_PATTERN = f"{KEYCAP_PATTERN}|[{_ranges(fixed.EMOJI_RANGES + fixed.MORE_EMOJI_RANGES)}]+"


def remove_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI_PATTERN, "")


# What is a mark within a line.
RULE = r"[-*_]{2,}\n?"
STARRED = r"\*[^*]+\*"
CODE = r"`[^`]+`"
EMPTY_FENCE = r"`{6}"
LINK = r"\[[^\]]+\]\([^)]+\)"
ADDRESS = r"https?://\S+"
# a mark, a run of letters that can begin none, or any one letter
MARKDOWN_TOKEN = rf"({RULE}|{STARRED}|{CODE}|{EMPTY_FENCE}|{LINK}|{ADDRESS}|[^-*_`\[h]+|[\s\S])"


def _is_block(line: Column, followed: Column) -> Column:
    """Headings and list items: the first word is hashes, a bullet or a number with a dot, and something comes after it."""
    words = F.split(line, r"\s", 2)
    sign = words[0]
    hashes = (sign != "") & (F.translate(sign, "#", "") == "")
    return (hashes | sign.isin("*", "-") | sign.rlike("^[0-9]+[.]$")) & ((F.size(words) > 1) | followed)


def _without_marks(c: Column, depth: int) -> Column:
    """The text read token by token: rules and addresses go, of emphasis, code and links the inside stays, read alike."""

    def plain(token: Column) -> Column:
        whole = lambda *kinds: token.rlike(rf"\A(?:{'|'.join(kinds)})\z")
        inside = F.substr(token, F.lit(2), F.length(token) - 2)
        label = F.substring_index(F.substr(token, F.lit(2)), "]", 1)
        again = (lambda x: _without_marks(x, depth - 1)) if depth else (lambda x: x)
        return (
            F.when(whole(RULE, EMPTY_FENCE, ADDRESS), "").when(whole(STARRED, CODE), again(inside)).when(whole(LINK), again(label)).otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(MARKDOWN_TOKEN)), plain), "")


def clean_markdown(c: Column) -> Column:
    """Without heading and list lines, rules, emphasis and code marks, link targets and bare addresses.

    Lines are judged first. What is left is read once from the left; marks inside of marks are read up to two levels deep.
    """
    lines = F.split(c, "\n")
    last = F.element_at(lines, -1)
    before = F.filter(F.slice(lines, 1, F.size(lines) - 1), lambda line: ~_is_block(line, F.lit(True)))
    end = F.when(_is_block(last, F.lit(False)), "").otherwise(last)
    return _without_marks(F.array_join(F.concat(before, F.array(end)), "\n"), 2)


# Patterns that decide which characters count as junk and which texts as Markdown.
LETTER_RUN = r"([а-яА-ЯёЁa-zA-Z\-]+)"
SPACED_RUN = r"([а-яА-ЯёЁa-zA-Z\- ]+)"
MARKDOWN_SIGN = r"(\*\*.+?\*\*|__.+?__|`.+?`|#+\s.+|\n[-*]\s|\n\d+\.\s|\[.+?\]\(.+?\))"
HEADER_LINE = r"(?m)^#{1,4}\s+"
LIST_LINE = r"(?m)^\d+\.\s+|^[-*]\s+"


def letter_words(c: Column) -> Column:
    """Runs of Cyrillic and Latin letters and hyphens, in order. Reading runs is far cheaper than replacing single characters."""
    return F.regexp_extract_all(c, F.lit(LETTER_RUN))


def clean_text(c: Column) -> Column:
    """Only Cyrillic and Latin letters, hyphens and single spaces."""
    return F.array_join(letter_words(c), " ")


def junk_ratio(c: Column) -> Column:
    """Share of characters that ``clean_text`` would blank out; 0 for an empty text."""
    n = F.length(c)
    kept = F.array_join(F.regexp_extract_all(c, F.lit(SPACED_RUN)), "")
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(kept)) / n)


NON_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"


def clean_question(c: Column) -> Column:
    """Lower case, no punctuation, trimmed."""
    return strip(F.regexp_replace(F.lower(c), NON_WORD, ""))


def dedupe_key(c: Column) -> Column:
    """Lower case, no punctuation, single spaces; '' for NULL."""
    t = F.regexp_replace(strip(F.lower(c)), NON_WORD, "")
    return F.coalesce(F.regexp_replace(t, rf"{BLANK}+", " "), F.lit(""))


def text_key(c: Column) -> Column:
    """Fixed-width key of a text, used to group and join long texts cheaply."""
    return F.sha2(c, 256)


def token_count(c: Column) -> Column:
    """Words plus single punctuation marks: the default length measure of the splitters."""
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


def cost_text(c: Column) -> Column:
    """Cost for display: 0, scientific below 1e-4, else up to six decimals."""
    fixed_point = F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    return F.when(c == 0, F.lit("0")).when(c < 0.0001, F.format_string("%.2e", c)).otherwise(fixed_point)


def strip_code_fence(c: Column) -> Column:
    """Model output without its surrounding ``` or ```json fence."""
    return F.regexp_replace(strip(c), r"^```(?:json)?\n|```$", "")


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\n\n", "")


def iso_date(c: Column) -> Column:
    """DD.MM.YYYY to ISO; text without a dot passes; '' when it is no date."""
    parsed = F.date_format(F.try_to_timestamp(c, F.lit("d.M.yyyy")), "yyyy-MM-dd")
    return F.when(c.contains("."), F.coalesce(parsed, F.lit(""))).otherwise(F.coalesce(c, F.lit("")))


def file_extension(c: Column) -> Column:
    """Lower-case extension of the last path segment, without the dot; '' when there is none."""
    return F.lower(F.regexp_extract(c, r"[^/\\]\.([^./\\]+)$", 1))


def is_image(c: Column) -> Column:
    return file_extension(c).isin(fixed.IMAGE_EXTENSIONS)


def trigrams(c: Column) -> Column:
    """Distinct letter trigrams of the padded words of a text, as PostgreSQL's pg_trgm builds them."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    per_word = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over united members of two arrays without duplicates; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def shared_words(asked: Column, text: Column) -> Column:
    """Share of the distinct words of a question that a text has, to six decimals; 0 for a question without words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)")))
    shared = F.try_divide(F.size(F.array_intersect(words(asked), words(text))), F.size(words(asked)))
    return F.round(F.coalesce(shared, F.lit(0.0)), 6)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def is_markdown(c: Column) -> Column:
    return c.rlike("(?d)" + MARKDOWN_SIGN)


def emphasize_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[([^\]]+)\]\((https?://[^\)]+)\)", r"*[$1]($2)*")


def split_strategy(c: Column) -> Column:
    """'markdown' for a text with enough headings and lists, else 'recursive'."""
    headers = F.regexp_count(c, F.lit("(?d)" + HEADER_LINE))
    lists = F.regexp_count(c, F.lit("(?d)" + LIST_LINE))
    structured = (headers >= 3) | ((headers >= 1) & (lists >= 2))
    return F.when(structured, F.lit("markdown")).otherwise(F.lit("recursive"))


def preview(c: Column, size: int = 200) -> Column:
    return F.left(c, F.lit(size))
