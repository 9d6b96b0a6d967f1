"""Text expressions. Word classes are ASCII, spelled out, so that every SQL engine reads them alike."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of retrieval.
STOP_WORDS = (
    "a an and are as at be but by for from has have i in is it its of on or that the this to was were will with you your my me we our not no do "
    "does did can could would should have had im ive dont cant just get got so if what when how why"
).split()
#: Patterns for lower-cased texts. A phrase pattern with \\b has its own bounds, any other stands between characters that are no word characters.
URL = r"https?://[^ \t\n\r\f]+|(^|[^\p{L}\p{N}_])www\.[^ \t\n\r\f]+"
MENTION = r"@[\p{L}\p{N}_]+"
DEFLECT = r"(?:\bdms?\b|\bd\.?m\.?\b|direct message|private message|\bpm us\b|inbox us|message us privately)"
THANKS = r"\b(?:thank(?:s| you)|cheers|appreciate it|sorted|fixed it|that worked|perfect|awesome|legend)\b"
SENSITIVE = (
    r"lawsuit|sue|suing|legal action|attorney|lawyer|court|subpoena|fraud|fraudulent|unauthorou?ised|stolen|identity theft|hacked|discriminat[a-z0-9_]*|racist|"
    r"harass[a-z0-9_]*|threat[a-z0-9_]*|died|death|passed away|funeral|hospital|medical|disabilit[a-z0-9_]*|self.?harm|suicid[a-z0-9_]*|kill myself|data breach|gdpr|"
    r"ombudsman|regulator|complaint to"
)
ACCOUNT_ACTION = (
    r"refund|charge ?back|reimburse|credit my|cancel my (account|subscription|plan)|close my account|delete my account|reset my password|change my (email|address|card)|"
    r"update my (card|billing|payment)|bill(ed|ing) me|double.?charged|unsubscribe me|downgrade my|upgrade my"
)
MASK = r"__[a-z0-9_]+__|\[(email|phone|url)\]"
#: Ranges of Latin letters.
LATIN = r"A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}"
#: Shapes of credentials.
SECRETS = {
    "auth_key": r"AQ\.[A-Za-z0-9_-]{40,}",
    "api_key": r"AIza[A-Za-z0-9_-]{30,}",
    "access_token": r"ya29\.[A-Za-z0-9_-]{40,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.",
    "key_variable": r"(GEMINI|GOOGLE)_API_KEY *[=:] *['\"]?[A-Za-z0-9_.-]{20,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "hex_token": r"token = \"[0-9a-f]{40}\"",
}


def between_words(pattern: str) -> str:
    r"""The pattern between characters that are no word characters; where it has \b of its own, these are written out instead, as engines read \b differently."""
    if r"\b" not in pattern:
        return f"(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)"
    return re.sub(r"\\b(?=[a-z0-9(])", "(?:^|[^a-z0-9_])", pattern).replace(r"\b", "(?:[^a-z0-9_]|$)")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; an expression that is named several times may be computed each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def by_letter(pattern: str) -> str | None:
    """The pattern with its alternatives grouped by their first letter, so that most are passed over at once; None where it has bounds or looks of its own."""
    if re.search(r"[\^$]|\\b|\(\?[^:]", pattern):
        return None
    parts, depth, groups = [""], 0, {}
    for c in re.findall(r"\\.|\[[^\]]*\]|.", pattern, re.S):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    for i, p in enumerate(parts):
        plain = re.match(r"[a-z0-9_](?![?*+{])", p)
        groups.setdefault(plain.group() if plain else i, []).append(p[1:] if plain else p)
    return "|".join((k if isinstance(k, str) else "") + f"(?:{'|'.join(v)})" for k, v in groups.items())


def has(text: Column, pattern: str) -> Column:
    """Whether a phrase of the pattern stands in the text, any case; null counts as an empty text."""
    low, quick = F.lower(F.coalesce(text, F.lit(""))), by_letter(pattern)
    if quick is None:
        return low.rlike(between_words(pattern))
    return F.concat(F.lit(" "), low, F.lit(" ")).rlike(f"[^a-z0-9_](?:{quick})[^a-z0-9_]")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def normalise(text: Column) -> Column:
    """Lower case without addresses and mentions, white space squeezed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return squeeze(F.regexp_replace(F.regexp_replace(low, URL, "$1 "), MENTION, " "))  # what stands before www is kept


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Retrieval tokens: ASCII words of two or more characters that are no stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    clean = F.regexp_replace(low, r"https?://[^ \t\n\r\f]+|@[a-z0-9_]+", " ")
    words = F.regexp_extract_all(clean, F.lit("[a-z0-9']+"), F.lit(0))
    left_out = sorted(set(STOP_WORDS if stop is None else stop))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(left_out))


def _unaccented() -> tuple[str, str]:
    """Letters of the Latin and Greek blocks with marks, and the same without."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xC0, 0x400), *range(0x1E00, 0x2000)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _unaccented()


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Words of two or more letters, digits or underscores, lower-cased and without accents, that are no stop words."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, BARE), r"\p{Mn}", "")
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(sorted(set(stop)))) if stop else words


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def blank_split_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(squeeze(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def low_quality(text: Column, least: int = 4) -> Column:
    """Fewer than ``least`` words once addresses, mentions and all that is no letter, digit, underscore or white space are gone."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(low, r"https?://[^ \t\n\r\f]+|@[\p{L}\p{N}_]+", " "), r"[^\p{L}\p{N}_ \t\n\r\f\x0B]", " ")
    return blank_split_count(bare) < least


def non_latin(text: Column, least: int = 3, share: float = 0.5) -> Column:
    """At least ``least`` letters, more than ``share`` of them outside the Latin ranges."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    others = F.regexp_replace(letters, f"[{LATIN}]", "")
    return (F.length(letters) >= least) & (F.length(others) > share * F.length(letters))


def symbols_only(text: Column) -> Column:
    """Symbols and white space only, at least one symbol."""
    return F.coalesce(text, F.lit("")).rlike(r"^[\p{So}\p{Sk}\s]+$") & F.coalesce(text, F.lit("")).rlike(r"[\p{So}\p{Sk}]")


def bucket(*parts: Column | str) -> Column:
    """A 32-bit hash as a long, from the md5 of the parts joined by ':'."""
    joined = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def flag(text: Column, true_words: tuple[str, ...] = ("true", "1", "t", "yes")) -> Column:
    """Whether a text says true; null says no."""
    return F.coalesce(F.lower(F.trim(text)).isin(*true_words), F.lit(False))


def whole_number(text: Column) -> Column:
    """A number's whole part, by way of a double; null for what is no number."""
    return text.try_cast("double").try_cast("long")


def clamp01(text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(text.try_cast("double"), F.lit(0.0))))


def rating(text: Column) -> Column:
    """1 to 5, else null."""
    value = F.bround(text.try_cast("double")).try_cast("int")
    return F.when(value.between(1, 5), value)


def name_key(text: Column) -> Column:
    """lower_snake_case."""
    return F.regexp_replace(F.lower(F.trim(text)), "[ -]", "_")


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def parse_json(text: Column) -> Column:
    """A variant from a model's reply: the whole, else a fenced block, else from the first to the last brace, else bracket; else null."""
    outer = lambda t, a, b: F.try_parse_json(F.regexp_extract(t, rf"(?s)(\{a}.*\{b})", 1))
    return let(text, lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), outer(t, "{", "}"), outer(t, "[", "]")))
