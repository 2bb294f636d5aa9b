"""Metadata from filenames and free-text fields: grade, school type, year, state, grade band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textatlas.functions.text import strip_diacritics, title_case, words

UNKNOWN = "Unbekannt"
NATIONAL = "KMK"

# Grade labels and school types, in order of precedence.
GRADE_LABELS = ["Sekundarstufe", "Sek1", "Sek2", "Sek1,2", "SekII", "Sek 1", "Sek 2", "Studienstufe"]
SCHOOL_TYPES = ["Gym", "Gymnasium", "GemS", "Regionale Schule"]
# State tokens of filenames that aren't abbreviations.
STATE_QUIRKS = {"BerlinBB": "Berlin", "RheinPfalz": "Rheinland-Pfalz"}
# The sixteen states, each with its aliases in lower case without diacritics.
STATES = {
    "Baden-Württemberg": ["bw", "baden wuerttemberg", "baden-wuerttemberg", "bawu"],
    "Bayern": ["by"],
    "Berlin": ["be"],
    "Brandenburg": ["bb"],
    "Bremen": ["hb"],
    "Hamburg": ["hh"],
    "Hessen": ["he"],
    "Mecklenburg-Vorpommern": ["mv", "meckpomm", "mecklenburg vorpommern"],
    "Niedersachsen": ["ni"],
    "Nordrhein-Westfalen": ["nrw", "nordrhein westfalen"],
    "Rheinland-Pfalz": ["rp", "rlp", "rheinland pfalz"],
    "Saarland": ["sl"],
    "Sachsen": ["sn"],
    "Sachsen-Anhalt": ["st", "sachsen anhalt"],
    "Schleswig-Holstein": ["sh", "schleswig holstein"],
    "Thüringen": ["th", "thueringen"],
}
# What stands for a missing state.
NO_STATE = ["<na>", "na", "n/a", "none", "nan", "kmk"]
# The display's own aliases, which it looks up without stripping diacritics.
DISPLAY_ALIASES = {"bawü": "Baden-Württemberg", "bawue": "Baden-Württemberg", "bawu": None}
# Name parts that tell the state of a catalogue file, in order of precedence.
CATALOG_STATES = [
    ("Bayern", "Bayern"), ("BaWü", "BaWü"), ("Berlin", "Berlin"), ("Bremen", "Bremen"), ("Hamburg", "Hamburg"),
    ("Hessen", "Hessen"), ("MeckPomm", "MeckPomm"), ("Niedersachsen", "Niedersachsen"), ("NRW", "NRW"),
    ("Nordrhein-Westfalen", "NRW"), ("Rheinland-Pfalz", "Rheinland-Pfalz"), ("Saarland", "Saarland"), ("Sachsen", "Sachsen"),
    ("Sachsen-Anhalt", "Sachsen-Anhalt"), ("Schleswig-Holstein", "Schleswig-Holstein"), ("Thüringen", "Thüringen"),
    ("Thueringen", "Thüringen"), ("KMK", "KMK"),
]
# Grade bands by lowest grade, and hints for texts without digits, in order of precedence.
GRADE_BANDS = [(1, 4, "1-4"), (5, 6, "5-6"), (7, 8, "7-8"), (9, 10, "9-10"), (11, 13, "11-13")]
GRADE_HINTS = [
    ("ef", "11-13"), ("einführungsphase", "11-13"), ("qualifikationsphase", "11-13"), ("oberstufe", "11-13"),
    ("sek ii", "11-13"), ("sekii", "11-13"), ("sek i", "7-10"), ("seki", "7-10"),
]


def _first_of(text: Column, cases: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for part, label in reversed(cases):
        out = F.when(text.contains(part), label).otherwise(out)
    return out


def extract_grade(name: Column) -> Column:
    """The first grade label in the name, else the first grade or range of grades that isn't a year, else null."""
    number = F.regexp_extract(name, r"(?U)\b(?!\d{4}\b)(\d{1,3}(?:[-,]\d{1,3})*)\b", 1)
    return F.coalesce(_first_of(name, [(g, g) for g in GRADE_LABELS]), F.nullif(number, F.lit("")))


def extract_school_type(name: Column) -> Column:
    """The first known type in the name, else its first word that holds "schule", else null."""
    named = F.get(F.filter(words(name), lambda w: w.contains("schule")), 0)
    return F.coalesce(_first_of(name, [(s, s) for s in SCHOOL_TYPES]), named)


def extract_year(name: Column) -> Column:
    """The first year 1900 to 2099, as text, else null."""
    return F.nullif(F.regexp_extract(name, r"(?U)\b(19\d{2}|20\d{2})\b", 1), F.lit(""))


def _state_cases(fold_marks: bool) -> dict[str, str]:
    import unicodedata

    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    cases: dict[str, str] = {}
    for state, aliases in STATES.items():
        for a in (state.lower(), *aliases):
            cases[plain(a) if fold_marks else a] = state
    return cases


def _lookup(key: Column, cases: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in cases.items() for x in pair]), key)


def _state_key(raw: Column) -> Column:
    return F.trim(F.lower(strip_diacritics(F.trim(raw))))


def canonical_state(raw: Column) -> Column:
    """One of the sixteen states, KMK for a missing one, else the text in title case."""
    key = _state_key(raw)
    missing = F.coalesce(F.trim(raw), F.lit("")).isin("") | key.isin(*NO_STATE)
    return F.when(missing, NATIONAL).otherwise(F.coalesce(_lookup(key, _state_cases(True)), title_case(F.trim(raw))))


def is_unmapped_state(raw: Column) -> Column:
    key = _state_key(raw)
    known = (F.coalesce(F.trim(raw), F.lit("")) == "") | key.isin(*NO_STATE) | _lookup(key, _state_cases(True)).isNotNull()
    return ~known


def unmapped_states(df: DataFrame, raw: str) -> DataFrame:
    """state, count of the raw states that no rule maps, most common first."""
    kept = df.select(F.trim(F.col(raw)).alias("state")).where(is_unmapped_state(F.col("state")))
    return kept.groupBy("state").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "state")


def display_state(raw: Column) -> Column:
    """As the tables show it: an alias in lower case with its marks, KMK for a missing one, else unchanged."""
    cases = _state_cases(False) | {k: NATIONAL for k in NO_STATE}
    for k, v in DISPLAY_ALIASES.items():
        cases.pop(k, None)
        if v:
            cases[k] = v
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(text == "", NATIONAL).otherwise(F.coalesce(_lookup(F.lower(text), cases), text))


def file_metadata(df: DataFrame, name: str = "file") -> DataFrame:
    """df with state, school_type, grade, year from the filename; hidden files are left out.

    A name without a second word has no state token, which counts as a missing state."""
    file, parts = F.col(name), words(F.col(name))
    token = F.get(parts, 1)
    for a, b in STATE_QUIRKS.items():
        token = F.when(token == a, b).otherwise(token)
    state = F.when(F.get(parts, 0) == NATIONAL, NATIONAL).otherwise(canonical_state(token))
    out = df.where(~file.startswith("."))
    return out.select(
        "*",
        state.alias("state"),
        extract_school_type(file).alias("school_type"),
        extract_grade(file).alias("grade"),
        extract_year(file).alias("year"),
    )


def infer_state(name: Column) -> Column:
    """State of a catalogue file by the first name part it holds, in any case."""
    return F.coalesce(_first_of(F.lower(name), [(p.lower(), label) for p, label in CATALOG_STATES]), F.lit(UNKNOWN))


def infer_year(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(20[0-9]{2})", 1), F.lit("")).cast("int")


def grade_band(raw: Column) -> Column:
    """Coarse band: of the least number in the text, else of a hint, else unknown. A number outside all bands stays."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    least = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")))
    band = least.cast("string")
    for lo, hi, label in GRADE_BANDS:
        band = F.when(least.between(lo, hi), label).otherwise(band)
    return F.when(least.isNotNull(), band).otherwise(F.coalesce(_first_of(text, GRADE_HINTS), F.lit(UNKNOWN)))


def clean_subject(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit(UNKNOWN))


def text_link(subject: Column, file: Column) -> Column:
    """Relative link to a document's text file, each part percent-encoded but for its blanks as %20; null without either."""
    name = F.regexp_replace(file, r"(?i)\.pdf$", ".txt")
    encoded = F.replace(F.url_encode(F.concat(subject, F.lit("/"), name)), F.lit("+"), F.lit("%20"))
    for code, sign in (("%2F", "/"), ("%2C", ","), ("%3B", ";"), ("%3A", ":"), ("%40", "@"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%24", "$"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%23", "#"), ("%3F", "?")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return F.when((F.coalesce(subject, F.lit("")) != "") & (F.coalesce(file, F.lit("")) != ""), F.concat(F.lit("./data/txtfiles/"), encoded))
