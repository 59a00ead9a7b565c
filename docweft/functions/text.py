"""Text functions as Column expressions: no UDFs, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns and lists decide what counts as a token, a heading, an anchor and so on,
# and must stay as they are for results to agree with existing labels and indexes.
TOKEN = r"[a-z]+\d+|\d[\d,\.]*|[a-z]+"
WORD = r"[a-z0-9]+"
GRADED_TOKEN = r"[a-z0-9@.]+"
ALIASES = {
    "h1": ("first", "half", "interim", "sixmonth"),
    "h2": ("second", "half"),
    "q1": ("first", "quarter"),
    "q2": ("second", "quarter"),
    "q3": ("third", "quarter"),
    "q4": ("fourth", "quarter"),
    "fy": ("full", "year", "annual"),
    "yoy": ("growth", "grew", "increase"),
    "pat": ("profit",),
    "pbt": ("profit",),
    "capex": ("capital", "expenditure"),
    "fiber": ("fibre",),
    "fibre": ("fiber",),
    "ebitda": ("earnings",),
}
STOP_WORDS = (
    "the", "a", "an", "of", "to", "in", "is", "are", "for", "and", "or", "you",
    "we", "on", "at", "by", "be", "it", "as", "our", "your", "with", "that",
    "this", "from", "may", "will", "can", "any", "all", "not", "no", "if",
)
CANDIDATE_STOP_WORDS = ("the", "a", "an", "of", "to", "in", "is", "are", "for", "and", "or", "you", "we")
# White space and digits are those of Unicode, and white space has the four separators below the blank.
BLANK = r"[\s\x1c-\x1f]"
FURNITURE = rf"(?Ui)^{BLANK}*(page{BLANK}+\d+({BLANK}+of{BLANK}+\d+)?|\d+{BLANK}*\|{BLANK}*page|\d+){BLANK}*$"
CLAUSE_NUMBER = rf"(?U)^{BLANK}*(\d+(?:\.\d+)*)\.?{BLANK}+(?=[^\s\x1c-\x1f])"
SENTENCE_GAP = rf"(?U)(?<=[.!?]){BLANK}+(?=[A-Z•●\-])"
SPACES = rf"(?U){BLANK}+"
ENDS = rf"(?U)^{BLANK}+|{BLANK}+$"
CHARS_PER_TOKEN = 3.5


def all_matches(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in order, with repeats; null for a null text."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Search tokens: period codes (``h1``), numbers with separators, words; lower case."""
    return all_matches(F.lower(text), TOKEN)


def with_aliases(toks: Column) -> Column:
    """Document tokens followed by the aliases of each, so that other wordings find the document."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.concat(toks, more)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return all_matches(F.lower(text), WORD)


def squeeze(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def norm_anchor(text: Column) -> Column:
    """Lower case; everything but letters, digits, ``@``, ``.`` and ``+`` becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9@.+]+", " "))


def norm_spaces(text: Column) -> Column:
    return squeeze(F.lower(text))


def norm_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def clean_cell(cell: Column) -> Column:
    return squeeze(F.coalesce(cell, F.lit("")))


def is_numeric_token(tok: Column) -> Column:
    """At least one digit, and nothing but digits, separators, signs, per cent and brackets."""
    return tok.rlike(r"(?U)\d") & tok.rlike(r"(?U)^[\d,.()%\-+]+$")


def is_data_value(cell: Column) -> Column:
    return tokens_nonempty(cell) & cell.rlike(r"(?U)\d") & cell.rlike(r"(?U)^[\d,.()%\-+\s\x1c-\x1f]+$")


def tokens_nonempty(cell: Column) -> Column:
    return F.length(cell) > 0


def blank_split(text: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(text, SPACES), lambda t: F.length(t) > 0)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where ``whole`` is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def digit_density(text: Column) -> Column:
    toks = blank_split(text)
    return share(F.size(F.filter(toks, is_numeric_token)), F.size(toks))


def is_furniture(line: Column) -> Column:
    return line.rlike(FURNITURE)


def is_heading(line: Column) -> Column:
    """Up to 80 characters and ten words, no closing mark; numbered, half capitalised, or a question."""
    s = squeeze_ends(line)
    ws = blank_split(s)
    n = F.size(ws)
    caps = F.size(F.filter(ws, lambda w: (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1))))
    shape = s.rlike(CLAUSE_NUMBER) | (caps >= F.greatest(F.lit(1), F.floor(n / 2))) | s.endswith("?")
    return (F.length(s) > 0) & (F.length(s) <= 80) & ~s.rlike(r"[.;,:]$") & (n >= 1) & (n <= 10) & shape


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` where a capital, a bullet or a hyphen follows the white space."""
    return F.split(text, SENTENCE_GAP)


def paragraphs(text: Column, least: int = 15) -> Column:
    """Blocks between blank lines, blanks squeezed, shorter ones than ``least`` dropped."""
    cut = F.transform(F.split(text, rf"(?U)\n{BLANK}*\n"), lambda p: F.regexp_replace(F.regexp_replace(p, "[ \t]+", " "), ENDS, ""))
    return F.filter(cut, lambda p: F.length(p) >= least)


def token_estimate(text: Column) -> Column:
    """Tokens a text is taken to have when no tokenizer is at hand; it errs on the large side."""
    return (F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)) + 1).cast("int")


def distinctive_tokens(norm: Column) -> Column:
    """Tokens of a normalised answer that are no stop words, longer than two letters, each once."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: ~F.array_contains(stop, t) & (F.length(t) > 2)))


def is_structured(tok: Column) -> Column:
    """An address, a figure or an identifier: it has an ``@`` or a digit."""
    return tok.rlike("[@0-9]")


def heading_and_body(text: Column) -> tuple[Column, Column]:
    """Up to and after the first line break; the body is empty if there is none."""
    return F.split(text, "\n", 2)[0], F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit(""))


def snippet(text: Column, n: int = 70) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def human_bytes(n: Column) -> Column:
    x = n.cast("double")
    one = lambda d: F.format_string("%.1f", F.bround(x / d, 1))
    return (F.when(x.isNull(), F.lit(None)).when(x < 1024, F.concat(F.format_string("%.0f", x), F.lit(" B"))).when(x < 1024**2, F.concat(one(1024.0), F.lit(" KB")))
            .when(x < 1024**3, F.concat(one(1024.0**2), F.lit(" MB"))).otherwise(F.concat(one(1024.0**3), F.lit(" GB"))))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(sha256: Column, ordinal: Column) -> Column:
    """Stable id of a chunk: the first eight digits of its document's hash, and its place there."""
    return F.concat_ws(":", F.substring(sha256, 1, 8), ordinal.cast("string"))


def squeeze_ends(text: Column) -> Column:
    """No white space at the ends; inside it stays as it is."""
    return F.regexp_replace(text, ENDS, "")
