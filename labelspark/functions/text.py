"""Text expressions. All stay in the JVM except Unicode normalisation."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Character classes, rewrite rules and markers that results
# depend on. Each rule is (pattern, replacement) and the order matters.
# ---------------------------------------------------------------------------

# Unicode white space; Java's \s is ASCII only.
ODD_WS = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[\s{ODD_WS}]"

QUOTES = r"[\u00b4\u2032\u2019\u02bc\u2018\u02bb`]"  # ´ ′ ’ ʼ ‘ ʻ `
DASHES = r"[\u2212\u2010\u2013\u2014]"  # − ‐ – —

# Rewrite rules: (characters one of which must occur, pattern, replacement).
CHAR_RULES = [
    ("", QUOTES, "'"),
    ("", DASHES, "-"),
    ("", "æ", "ae"),
    ("", "œ", "oe"),
]
LIGATURE_RULES = CHAR_RULES[2:]

CORPUS_RULES = [
    ("'", f"{WS}*'{WS}*", "'"),
    ("", f"{WS}+([,.])", "$1"),
    ("(", rf"\({WS}+", "("),
    (")", rf"{WS}+\)", ")"),
    ("/", f"{WS}*/{WS}*", "/"),
]

FEATURE_RULES = [
    ("'", f"{WS}*'{WS}*", "' "),
    ("", f"{WS}*([,.:;!?])", " $1"),
    ("-/", f"{WS}*([-/]){WS}*", " $1 "),
    ("(", rf"\({WS}*", "( "),
    (")", rf"{WS}*\)", " )"),
    ("", f"{WS}+", " "),
]

BAG_RULES = [
    ("'", f"{WS}*'{WS}*", "' "),
    ("", f"{WS}+", " "),
]

WORD = r"[\p{L}\p{N}_]{2,}"
# Texts of a batch that are Python strings at one time.
TEXTS_AT_ONCE = 64
LABEL_MARK = "__label__"
ANSWER_HEADING = r"(?iu)#{2,3} (?:Analysis and Code Assignment|Analysis|Result)"
NO_CODE = ["0", ""]

# ---------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def opened(df: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """(keep…, name): one row per non-null array element.

    For a computed array the planner would copy its expression into a filter on
    the array's size and evaluate it twice; the outer form has no such filter.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _guarded(needs: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    def rule(x: Column) -> Column:
        found = reduce(lambda a, b: a | b, [F.contains(x, F.lit(c)) for c in needs])
        return F.when(found, F.regexp_replace(x, pattern, replacement)).otherwise(x)

    return rule


def _apply(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    for needs, pattern, replacement in rules:
        text = let(text, _guarded(needs, pattern, replacement)) if needs else F.regexp_replace(text, pattern, replacement)
    return text


def rewrite(text: Column, char_rules: Sequence[tuple[str, str, str]],
            space_rules: Sequence[tuple[str, str, str]]) -> Column:
    """Apply single-character rules, then the rules about white space.

    Most text has none of the special characters and only ASCII white space:
    one look each decides, and the plain forms of the rules run much faster.
    """
    special = "[" + "".join(p.strip("[]") for _, p, _ in char_rules) + "]"
    plain = [(n, p.replace(WS, r"\s"), r) for n, p, r in space_rules]
    chars = let(text, lambda x: F.when(x.rlike(special), _apply(x, char_rules)).otherwise(x))
    return let(
        chars,
        lambda x: F.when(x.rlike(f"[{ODD_WS}]"), _apply(x, space_rules)).otherwise(_apply(x, plain)),
    )


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def clean_text(text: Column) -> Column:
    """Corpus clean-up: quotes, dashes, ligatures, stray blanks. Keeps case."""
    return rewrite(text, CHAR_RULES, CORPUS_RULES)


def _normalized(text: pa.Array, form: str) -> pa.Array:
    """Texts of a batch become Python strings a few at a time."""
    parts = [
        pa.array([None if t is None else unicodedata.normalize(form, t) for t in text[at : at + TEXTS_AT_ONCE].to_pylist()], pa.string())
        for at in range(0, len(text), TEXTS_AT_ONCE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _nfkd(text: pa.Array) -> pa.Array:
    return _normalized(text, "NFKD")


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return _normalized(text, "NFKC")


def unicode_form(text: Column, form: str) -> Column:
    """NFKD or NFKC. ASCII text is its own normal form and skips Python."""
    udf = {"NFKD": _nfkd, "NFKC": _nfkc}[form]
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(udf(foreign), text)


def normalize_features(text: Column) -> Column:
    """Feature form: lower case, NFKD, spaced punctuation, single blanks."""
    return strip(rewrite(unicode_form(F.lower(text), "NFKD"), CHAR_RULES, FEATURE_RULES))


def remove_symbols(text: Column, keep: str = "") -> Column:
    """NFKC, then marks, symbols and punctuation become blanks unless kept."""
    kept = "".join("\\" + c for c in keep)
    exception = f"&&[^{kept}]" if kept else ""
    return F.regexp_replace(unicode_form(text, "NFKC"), rf"[\p{{M}}\p{{S}}\p{{P}}{exception}]", " ")


def normalize_bag(text: Column) -> Column:
    """Bag-of-words form: lower case, no symbols but the apostrophe."""
    return strip(rewrite(remove_symbols(F.lower(text), keep="'"), LIGATURE_RULES, BAG_RULES))


def word_tokens(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, in text order."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def without_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    words = list(stopwords)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def default_stopwords(language: str = "french") -> list[str]:
    """Spark's own list for a language; needs an active session."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


def analyze(
    text: Column,
    normalize: Callable[[Column], Column] = normalize_features,
    stopwords: Sequence[str] = (),
    stem: Callable[[Column], Column] | None = None,
) -> Column:
    """normalise → words → stop words → stems, as an array of terms.

    ``stem`` must be a built-in expression here; a Python stemmer goes through
    ``features.stem_terms``, once per distinct word.
    """
    tokens = without_stopwords(word_tokens(normalize(text)), stopwords)
    return F.transform(tokens, stem) if stem else tokens


def num_words(text: Column) -> Column:
    """Count of white-space separated words; 0 for empty text."""
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != "")).cast("bigint")


def remove_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n", "")


def concat_texts(columns: Sequence[str], delimiter: str = " ") -> Column:
    """Concatenate text columns; a null counts as empty text."""
    return F.concat_ws(delimiter, *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def tokens_to_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def any_tag_contains(tags: Column, names: Sequence[str], part: str = "DISO") -> Column:
    """True if the name of any tag id contains ``part``; false when empty."""
    wanted = [i for i, name in enumerate(names) if part in name]
    return F.exists(tags, lambda t: t.isin(wanted)) if wanted else F.lit(False)


def split_name(path: Column) -> Column:
    """File stem with ``-`` and ``_`` turned into dots."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\z", 1), r"(?<=.)\.[^.]*\z", "")
    return F.regexp_replace(stem, "[-_]", ".")


def slug(name: Column) -> Column:
    """Lower case with underscores for dashes."""
    return F.lower(F.regexp_replace(name, "-", "_"))


def labelled_line(labels: Column, text: Column) -> Column:
    """``__label__a __label__b text``; no labels leaves a leading blank."""
    marks = F.array_join(F.transform(labels, lambda l: F.concat(F.lit(LABEL_MARK), l)), " ")
    return F.concat(marks, F.lit(" "), text)


def line_labels(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda t: t.contains(LABEL_MARK))


def line_text(line: Column) -> Column:
    return F.array_join(F.filter(F.split(line, " "), lambda t: ~t.contains(LABEL_MARK)), " ")


def answer_sections(output: Column) -> Column:
    """Stripped sections of a model answer after each known heading."""
    unfenced = F.regexp_replace(output, r"^```|```(?=\n?\z)", "")
    parts = F.split(unfenced, ANSWER_HEADING, -1)
    return F.transform(F.slice(parts, 2, F.size(parts)), strip)


def answer_labels(sections: Column) -> Column:
    """Codes of the second section; null unless there are exactly two."""

    def codes(found: Column) -> Column:
        split = F.split(F.element_at(found, 2), f",{WS}*", -1)
        return F.when(F.size(found) == 2, F.filter(split, lambda c: ~c.isin(NO_CODE)))

    return let(sections, codes)


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` fields in one pass; ``{{`` and ``}}`` are braces.

    Braces inside values stay as they are. A field without a value is an error.
    """
    pieces: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field not in values:
                raise KeyError(f"template field {field!r} has no value")
            pieces.append(values[field])
    return F.concat(*pieces) if pieces else F.lit("")


def map_names(name: Column, names: Mapping[str, str]) -> Column:
    """Look a name up in a short fixed mapping; unmapped becomes null."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), name)
