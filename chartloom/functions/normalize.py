"""Normalized artist names and titles as column expressions.

All of it runs in the JVM. Edition suffixes are taken off from the end, one after the other, by a fold over at most
five passes; each pass finds the first pattern that fits.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Artists that keep their article, artists that keep their punctuation.
KEEP_ARTICLE = ["the the", "the 1975", "the weeknd", "de dijk", "de jeugd van tegenwoordig", "het goede doel"]
KEEP_PUNCTUATION = ["p!nk", "fun.", "blink-182", "will.i.am", "!!!", "(hed) p.e.", "mø", "björk"]
STOPWORDS = ["the", "a", "an", "and", "or", "but"]
#: Letters that don't decompose.
LETTERS = {"ø": "o", "å": "a", "æ": "ae", "ð": "d", "þ": "th", "ß": "ss", "œ": "oe", "ł": "l"}
#: Bracketed suffixes by kind, in the order in which they are tried, and the field that the group fills.
SUFFIXES = [
    ("edit", "sub", r"""(radio\s+edit|single\s+edit|7"\s*edit|edit)"""),
    ("live", "value", r"live(?:\s+at\s+([^)\]]+))?"),
    ("remaster", "value", r"remaster(?:ed)?(?:\s+(\d{4}))?"),
    ("mix", "sub", r"(mono|stereo)"),
    ("acoustic", "note", r"(acoustic|unplugged|piano\s+version)"),
    ("remix", "value", r"([^)\]]*remix)"),
    ("extended", "sub", r"""(extended(?:\s+mix)?|12"\s*mix|club\s+mix|dub|instrumental|karaoke\s+version)"""),
    ("demo", "", r"(demo|early\s+version|rough\s+mix)"),
    ("content", "sub", r"(clean|explicit)"),
    ("re_recording", "note", r"(re-recorded|taylor'?s\s+version|new\s+recording)"),
    ("medley", "", r"(medley)"),
    ("karaoke", "", r"(originally\s+performed\s+by\s+[^)\]]+|karaoke(?:\s+version)?)"),
    ("session", "sub", r"(peel)\s+session"),
]
PATTERNS = [rf"(?i)\s*[(\[]\s*{inner}\s*[)\]]$" for *_, inner in SUFFIXES] + [r"(?i)\s*-\s*(remaster(?:ed)?\s+\d{4}|live\s+at\s+.+|radio\s+edit|single\s+version)$"]
#: Patterns of guests after an artist, of guests in a title's brackets, and of a film's name in quotes before a title.
GUESTS = r"(?i)\s+(?:feat\.?|featuring|ft\.?|met|with|con)\s+"
TITLE_GUESTS = r"(?i)\s*[(\[]\s*(?:feat\.?|featuring|ft\.?|met|with)\s+([^)\]]+)[)\]]"
FILM = r"""(?i)^(?:from\s+"([^"]+)"|from\s+'([^']+)'|uit\s+"([^"]+)"|van de film\s+"([^"]+)")"""
MAX_PASSES = 5
#: Letters whose case folding isn't their lower case: sharp and final s, ligatures.
FOLDS = {"ß": "ss", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn"}


#: Syllables of Hangul, and what they are made of by arithmetic: leading, vowel and trailing letters, 19 * 21 * 28 combinations.
HANGUL, LEADS, VOWELS, TRAILS = "가-힣", "".join(map(chr, range(0x1100, 0x1113))), "".join(map(chr, range(0x1161, 0x1176))), "".join(map(chr, range(0x11A8, 0x11C3)))


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Letters with marks, and the letters without, for those that decompose into one letter and marks; and those that decompose into several letters, but Hangul."""
    marked, plain, several = [], [], {}
    for code in range(0xC0, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3 or chr(code) in LETTERS:
            continue
        whole = unicodedata.normalize("NFD", chr(code))
        parts = [c for c in whole if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code):
            marked.append(chr(code))
            plain.append(parts[0])
        elif len(parts) > 1:
            several[chr(code)] = "".join(parts)
    return "".join(marked), "".join(plain), several


MARKED, PLAIN, SEVERAL = _plain_letters()


def squeeze(text: Column) -> Column:
    """White space to single spaces, no zero-width characters, nothing at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "[\u200b-\u200d\ufeff]", ""))


def fold_case(text: Column) -> Column:
    out = F.lower(text)
    for letter, to in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(to))
    return out


def plain_punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def strip_diacritics(text: Column) -> Column:
    """Letters without marks, of lower-case text."""
    for letter, to in LETTERS.items():
        if len(to) > 1:
            text = F.replace(text, F.lit(letter), F.lit(to))
    singles = [k for k, to in LETTERS.items() if len(to) == 1]
    text = F.translate(text, MARKED + "".join(singles), PLAIN + "".join(LETTERS[k] for k in singles))
    text = F.regexp_replace(text, r"\p{Mn}", "")
    # Texts with syllables, or with vowels of several letters, go letter by letter.
    several = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(f"[{HANGUL}]"), _syllable(F.ascii(c) - 0xAC00)).otherwise(F.coalesce(F.try_element_at(several, c), c)))
    return F.when(text.rlike(f"[{HANGUL}{''.join(SEVERAL)}]"), F.array_join(letters, "")).otherwise(text)


def _syllable(n: Column) -> Column:
    """The letters of the syllable of Hangul with this number."""
    at = lambda letters, i: F.substr(F.lit(letters), i.cast("int"), F.lit(1))
    trail = F.when(n % 28 == 0, "").otherwise(at(TRAILS, n % 28))
    return F.concat(at(LEADS, F.floor(n / 588) + 1), at(VOWELS, F.floor(n % 588 / 28) + 1), trail)


def compact(text: Column) -> Column:
    """Single spaces, and no dash or space at the end."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[-\s]+$", "")


def _bare(text: Column) -> Column:
    return compact(strip_diacritics(fold_case(text)))


def artist_guests(artist: Column) -> Column:
    parts = F.split(squeeze(artist), GUESTS)
    named = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda g: F.trim(g)), lambda g: g != "")
    return F.transform(named, _bare)


def artist_core(artist: Column, every_x: bool = True) -> Column:
    """The normalized artist. every_x: any letter x parts artists, as the rules have it; else only one between spaces does."""
    s = squeeze(artist)
    core = strip_diacritics(plain_punctuation(fold_case(F.trim(F.split(s, GUESTS)[0]))))
    core = F.regexp_replace(core, r"\s*[&+x×/,]\s*" if every_x else r"\s*[&+×/,]\s*|\s+x\s+", " • ")
    several = F.size(F.split(F.trim(core), r"\s+")) > 1
    core = F.when(~F.lower(artist).isin(KEEP_ARTICLE) & core.startswith("the ") & several, F.substr(core, F.lit(5))).otherwise(core)
    return F.when(F.lower(s).isin(KEEP_PUNCTUATION), F.lower(s)).otherwise(compact(core))


def film_prefix(title: Column) -> Column:
    """struct(rest, work): a title without `From "work"` before it; work is null if there is none."""
    s = squeeze(title)
    work = F.concat(*[F.regexp_extract(s, FILM, i) for i in range(1, 5)])
    return F.when(s.rlike(FILM), F.struct(F.trim(F.regexp_replace(s, FILM, "")).alias("rest"), work.alias("work"))).otherwise(F.struct(s.alias("rest"), F.lit(None).cast("string").alias("work")))


TAG = "struct<kind:string,sub:string,value:string,note:string>"


def _tag(kind: Column, sub: Column, value: Column, note: Column) -> Column:
    return F.struct(kind.alias("kind"), sub.alias("sub"), value.alias("value"), note.alias("note")).cast(TAG)


def _describe(hit: Column, found: Column) -> Column:
    """The tag of pattern number `hit` whose group is `found` (lower case, null if empty)."""
    none = F.lit(None).cast("string")
    has = lambda x: F.contains(found, F.lit(x))
    edit = F.when(has("radio"), "radio").when(has("single"), "single").when(has('7"'), "7in").otherwise("edit")
    extended = F.when(has("12"), "12in").when(has("club"), "club").when(has("dub"), "dub").when(has("instrumental"), "instrumental").when(has("karaoke"), "karaoke").otherwise("extended")
    out = (
        F.when((hit == len(SUFFIXES)) & has("remaster"), _tag(F.lit("remaster"), none, F.regexp_extract(found, r"(\d{4})", 1), none))
        .when((hit == len(SUFFIXES)) & has("live"), _tag(F.lit("live"), none, F.trim(F.replace(found, F.lit("live at"), F.lit(""))), none))
        .when((hit == len(SUFFIXES)) & has("edit"), _tag(F.lit("edit"), F.when(has("radio"), "radio").otherwise("single"), none, none))
        .when(hit == len(SUFFIXES), _tag(F.lit("edit"), F.lit("version"), none, none))
    )
    for i, (kind, field, _) in enumerate(SUFFIXES):
        sub = edit if kind == "edit" else extended if kind == "extended" else found
        out = out.when(hit == i, _tag(F.lit(kind), sub if field == "sub" else none, found if field == "value" else none, found if field == "note" else none))
    return out


def edition_suffixes(title: Column) -> Column:
    """struct(rest, tags): a title without edition suffixes. A rest of one stopword that is less than 30% of the title undoes all."""
    patterns = F.array(*[F.lit(p) for p in PATTERNS])

    def one(acc: Column, _: Column) -> Column:
        s = acc["rest"]
        hit = F.coalesce(*[F.when(s.rlike(p), F.lit(i)) for i, p in enumerate(PATTERNS)])

        def apply(h: Column) -> Column:
            found = F.nullif(F.trim(F.lower(F.call_function("regexp_extract", s, F.element_at(patterns, h + 1), F.lit(1)))), F.lit(""))
            after = F.struct(F.trim(F.regexp_replace(s, F.element_at(patterns, h + 1), F.lit(""))).alias("rest"), F.concat(acc["tags"], F.array(_describe(h, found))).alias("tags"))
            return F.when(h.isNull(), acc).otherwise(after)

        return F.element_at(F.transform(F.array(hit), apply), 1)

    start = F.struct(title.alias("rest"), F.array().cast(f"array<{TAG}>").alias("tags"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_PASSES)), start, one)
    guard = lambda d: F.when((F.length(d["rest"]) < F.length(title) * 0.3) & F.lower(F.trim(d["rest"])).isin(STOPWORDS), start).otherwise(d)
    return F.element_at(F.transform(F.array(done), guard), 1)


def title_guests(title: Column) -> Column:
    """Guests named in brackets anywhere in a title (after its edition suffixes)."""
    return F.transform(F.regexp_extract_all(title, F.lit(TITLE_GUESTS), 1), lambda g: _bare(F.trim(g)))


def normalize_title(title: Column) -> Column:
    """struct(core, guests, tags) of a title."""

    def finish(film: Column) -> Column:
        def rest(edition: Column) -> Column:
            text = F.trim(F.regexp_replace(edition["rest"], TITLE_GUESTS, ""))
            film_tag = F.when(film["work"].isNotNull(), F.array(_tag(F.lit("ost"), F.lit(None), film["work"], F.lit(None)))).otherwise(F.array().cast(f"array<{TAG}>"))
            return F.struct(
                compact(strip_diacritics(plain_punctuation(fold_case(text)))).alias("core"),
                title_guests(edition["rest"]).alias("guests"),
                F.concat(film_tag, edition["tags"]).alias("tags"),
            )

        return F.element_at(F.transform(F.array(edition_suffixes(film["rest"])), rest), 1)

    return F.element_at(F.transform(F.array(film_prefix(title)), finish), 1)


def tags_text(tags: Column) -> Column:
    """Tags as text, kind/sub/value/note with dashes for what is missing."""
    dash = lambda x: F.coalesce(x, F.lit("-"))
    return F.array_join(F.transform(tags, lambda t: F.concat_ws("/", t["kind"], dash(t["sub"]), dash(t["value"]), dash(t["note"]))), ";")


def has_tag(tags: Column, kind: str) -> Column:
    return F.exists(tags, lambda t: F.coalesce((t["kind"] == kind) | (t["sub"] == kind), F.lit(False)))


def entry_unit(tags: Column) -> Column:
    """The unit of the first medley (medley) or karaoke (unknown) tag, else recording."""
    kinds = F.transform(F.filter(tags, lambda t: t["kind"].isin("medley", "karaoke")), lambda t: F.when(t["kind"] == "medley", "medley").otherwise("unknown"))
    return F.coalesce(F.get(kinds, 0), F.lit("recording"))


def previous_position(text: Column) -> Column:
    """`(12)` or `12` is a number; `-`, `re`, `nieuw`, blanks and 0 aren't."""
    n = F.regexp_extract(F.trim(text), r"^\(?\s*([0-9]+)\s*\)?$", 1).try_cast("int")
    return F.when(n > 0, n)


def strip_notes(text: Column) -> Column:
    """Without `((…))` and `[…]`, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"\(\([^)]*\)\)", ""), r"\[[^\]]*\]", ""))


#: Fixed value: what counts as an address.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[EMAIL]")


#: A key that contains one of these, in any case, names a secret.
SECRETS = ["password", "secret", "token", "api_key", "apikey", "auth", "authorization", "credential", "access_token", "refresh_token", "client_secret", "private_key"]


def redact_secrets(values: Column, words: tuple[str, ...] = tuple(SECRETS)) -> Column:
    """A map whose values under secret-like keys keep four characters; values of up to four keep none."""
    secret = lambda k: F.lower(k).rlike("|".join(words))
    hidden = lambda v: F.when(F.length(v) <= 4, "***").otherwise(F.concat(F.substring(v, 1, 4), F.lit("***")))
    return F.transform_values(values, lambda k, v: F.when(secret(k), hidden(v)).otherwise(v))


def redact_json(text: Column, words: tuple[str, ...] = tuple(SECRETS)) -> Column:
    """JSON text in which strings under secret-like keys are redacted like in redact_secrets, however deep they stand."""
    key = r'(?i)("[^"\\]*(?:' + "|".join(words) + r')[^"\\]*"\s*:\s*")'
    letter = r'(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])'
    short = F.regexp_replace(text, key + letter + '{0,4}"', '$1***"')
    return F.regexp_replace(short, key + "(" + letter + "{4})" + letter + '+"', '$1$2***"')


def marks_of(text: str | None) -> str | None:
    """`position:character` of every mark or letter that doesn't decompose, in the fully decomposed text."""
    if text is None:
        return None
    return ",".join(f"{i}:{c}" for i, c in enumerate(unicodedata.normalize("NFD", text)) if unicodedata.category(c) == "Mn" or c.lower() in LETTERS)


def _marks(text: pd.Series) -> pd.Series:
    return text.map(marks_of)


def diacritics_signature(text: Column | str) -> Column:
    """Where the marks of a text are. Decomposition isn't a function of Spark's SQL, so this goes by Arrow batches."""
    return F.pandas_udf(_marks, "string")(text)
