"""French stems, after the published description of the Snowball stemmer.

A word is marked, cut and mended from its end, step by step; where its regions begin
is settled before. Everything is a column expression over one word: stem distinct
words and join (``features.stem_terms``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import let

# Fixed values of the published algorithm: its vowels and the endings of its steps.
VOWELS = "aeiouyâàëéêèïîôûù"
V, NOT_V = f"[{VOWELS}]", f"[^{VOWELS}]"
ABSTRACT = ["ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"]
ACTION = ["atrice", "ateur", "ation", "atrices", "ateurs", "ations"]
FIRST = [
    *ABSTRACT, *ACTION, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements", "ité", "ités",
    "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments",
]
I_VERBS = [
    "îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras", "irent", "irez", "iriez", "irions",
    "irons", "iront", "is", "issaIent", "issais", "issait", "issant", "issante", "issantes", "issants", "isse", "issent", "isses", "issez",
    "issiez", "issions", "issons", "it",
]
E_VERBS = ["é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez", "erions", "erons", "eront", "ez", "iez"]
A_VERBS = ["âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses", "assiez", "assions"]


def _ending(word: Column, endings: list[str], start: Column | None = None) -> Column:
    """The longest of some endings that the word has, inside the region from ``start``
    (letters before it); empty if it has none."""
    text = word if start is None else F.substring(word, start + 1, F.length(word))
    return F.regexp_extract(text, f"({'|'.join(endings)})$", 1)


def _without(word: Column, n: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def marked(word: Column) -> Column:
    """Vowels that stand for consonants become capital letters, from left to right:
    a letter after a marked one is not marked for it."""
    out = F.regexp_replace(word, "qu", "qU")
    out = F.regexp_replace(out, f"(?<={V})y|y(?={V})", "Y")
    out = F.regexp_replace(out, f"(?<={V})([ui])([ui]?)(?=[{VOWELS}Y])", "<$1>$2")
    return F.regexp_replace(F.regexp_replace(out, "<u>", "U"), "<i>", "I")


def _regions(word: Column) -> Column:
    """struct(rv, r1, r2): letters before each region."""
    whole = F.length(word)
    after = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    found = lambda text, pattern: F.when(text.rlike(pattern), after(text, pattern))
    rv = F.when(word.rlike(f"^{V}{V}.") | word.rlike("^(par|col|tap)"), F.lit(3)).otherwise(
        F.coalesce(found(word, f"^.{NOT_V}*{V}"), whole)
    )
    to_next = f"^.*?{V}{NOT_V}"

    def with_first(r1: Column) -> Column:
        rest = F.substring(word, r1 + 1, whole)
        r2 = F.coalesce(r1 + found(rest, to_next), whole)
        return F.struct(F.least(rv, whole).alias("rv"), r1.alias("r1"), r2.alias("r2"))

    return let(F.coalesce(found(word, to_next), whole), with_first)


def _standard(word: Column, at: Column) -> Column:
    """Step 1: the word without a standard suffix."""

    def of(s: Column) -> Column:
        rest, whole = _without(word, F.length(s)), F.length(word)
        begin = whole - F.length(s)
        r1, r2, rv = begin >= at["r1"], begin >= at["r2"], begin >= at["rv"]

        def preceded(text: Column, before: str, otherwise: str) -> Column:
            """Delete what stands before too if it lies in R2, else put another."""
            cut = _without(text, len(before))
            return F.when(F.length(cut) >= at["r2"], cut).otherwise(F.concat(cut, F.lit(otherwise)))

        kept_if = lambda text, before: F.when(F.length(text) - len(before) >= at["r2"], _without(text, len(before))).otherwise(text)
        action = F.when(rest.endswith("ic"), preceded(rest, "ic", "iqU")).otherwise(rest)
        at_iv = let(kept_if(rest, "iv"), lambda t: F.when((F.length(t) < F.length(rest)) & t.endswith("at"), kept_if(t, "at")).otherwise(t))
        eus = F.when(F.length(rest) - 3 >= at["r2"], _without(rest, 3)).when(F.length(rest) - 3 >= at["r1"], F.concat(_without(rest, 1), F.lit("x"))).otherwise(rest)
        ement = (
            F.when(rest.endswith("iv"), at_iv)
            .when(rest.endswith("eus"), eus)
            .when(rest.endswith("abl"), kept_if(rest, "abl"))
            .when(rest.endswith("iqU"), kept_if(rest, "iqU"))
            .when(rest.rlike("[iI]èr$"), F.when(F.length(rest) - 3 >= at["rv"], F.concat(_without(rest, 3), F.lit("i"))).otherwise(rest))
            .otherwise(rest)
        )
        ite = (
            F.when(rest.endswith("abil"), preceded(rest, "abil", "abl"))
            .when(rest.endswith("ic"), preceded(rest, "ic", "iqU"))
            .when(rest.endswith("iv"), kept_if(rest, "iv"))
            .otherwise(rest)
        )
        atif = let(kept_if(rest, "at"), lambda t: F.when((F.length(t) < F.length(rest)) & t.endswith("ic"), preceded(t, "ic", "iqU")).otherwise(t))
        put = lambda test, text: F.when(test, F.concat(rest, F.lit(text))).otherwise(word)
        return (
            F.when(s == "", word)
            .when(s.isin(ABSTRACT), F.when(r2, rest).otherwise(word))
            .when(s.isin(ACTION), F.when(r2, action).otherwise(word))
            .when(s.isin("logie", "logies"), put(r2, "log"))
            .when(s.isin("usion", "ution", "usions", "utions"), put(r2, "u"))
            .when(s.isin("ence", "ences"), put(r2, "ent"))
            .when(s.isin("ement", "ements"), F.when(rv, ement).otherwise(word))
            .when(s.isin("ité", "ités"), F.when(r2, ite).otherwise(word))
            .when(s.isin("if", "ive", "ifs", "ives"), F.when(r2, F.when(rest.endswith("at"), atif).otherwise(rest)).otherwise(word))
            .when(s == "eaux", F.concat(rest, F.lit("eau")))
            .when(s == "aux", put(r1, "al"))
            .when(s.isin("euse", "euses"), F.when(r2, rest).when(r1, F.concat(rest, F.lit("eux"))).otherwise(word))
            .when(s.isin("issement", "issements"), F.when(r1 & rest.rlike(f"{NOT_V}$"), rest).otherwise(word))
            .when(s == "amment", put(rv, "ant"))
            .when(s == "emment", put(rv, "ent"))
            .otherwise(F.when(rest.rlike(f"{V}$") & (F.length(rest) - 1 >= at["rv"]), rest).otherwise(word))
        )

    return let(_ending(word, sorted(FIRST, key=len, reverse=True)), of)


def _i_verb(word: Column, at: Column) -> Column:
    """Step 2a, inside RV."""

    def of(s: Column) -> Column:
        rest = _without(word, F.length(s))
        good = (s != "") & rest.rlike(f"{NOT_V}$") & (F.length(rest) - 1 >= at["rv"])
        return F.when(good, rest).otherwise(word)

    return let(_ending(word, sorted(I_VERBS, key=len, reverse=True), at["rv"]), of)


def _other_verb(word: Column, at: Column) -> Column:
    """Step 2b, inside RV."""

    def of(s: Column) -> Column:
        rest = _without(word, F.length(s))
        e_before = rest.endswith("e") & (F.length(rest) - 1 >= at["rv"])
        return (
            F.when(s == "", word)
            .when(s == "ions", F.when(F.length(rest) >= at["r2"], rest).otherwise(word))
            .when(s.isin(E_VERBS), rest)
            .otherwise(F.when(e_before, _without(rest, 1)).otherwise(rest))
        )

    return let(_ending(word, sorted(["ions", *E_VERBS, *A_VERBS], key=len, reverse=True), at["rv"]), of)


def _residual(word: Column, at: Column) -> Column:
    """Step 4: what is left of a word that no other step changed."""

    def of(w: Column) -> Column:
        def tail(s: Column) -> Column:
            rest = _without(w, F.length(s))
            begin = F.length(rest)
            return (
                F.when(s == "ion", F.when((begin >= at["r2"]) & rest.rlike("[st]$") & (begin - 1 >= at["rv"]), rest).otherwise(w))
                .when(s.isin("ier", "ière", "Ier", "Ière"), F.concat(rest, F.lit("i")))
                .when(s == "e", rest)
                .when(s == "ë", F.when(rest.endswith("gu") & (begin - 2 >= at["rv"]), rest).otherwise(w))
                .otherwise(w)
            )

        return let(_ending(w, ["ière", "Ière", "ion", "ier", "Ier", "e", "ë"], at["rv"]), tail)

    return let(F.when(word.rlike("[^aiouès]s$"), _without(word, 1)).otherwise(word), of)


def french_stem(word: Column) -> Column:
    """The stem of a lower-case French word; null stays null."""

    def with_regions(s: Column) -> Column:
        w, at = s["w"], s["at"]

        def after_first(first: Column) -> Column:
            # the verb endings are looked at where nothing went, or only an adverb's ending
            adverb = w.rlike("(amment|emment|ments?)$") & ~w.rlike("(ements?|issements?)$")
            adverb = adverb | w.rlike("emment$")

            def after_i(second: Column) -> Column:
                verb = F.when((first != w) & ~adverb, first).when(second != first, second).otherwise(_other_verb(first, at))

                def end(third: Column) -> Column:
                    mended = F.regexp_replace(F.regexp_replace(third, "Y$", "i"), "ç$", "c")
                    return F.when(third != w, mended).otherwise(_residual(w, at))

                return let(verb, end)

            return let(_i_verb(first, at), after_i)

        return let(_standard(w, at), after_first)

    def finish(stem: Column) -> Column:
        single = F.when(stem.rlike("(enn|onn|ett|ell|eill)$"), _without(stem, 1)).otherwise(stem)
        return F.lower(F.regexp_replace(single, f"[éè]({NOT_V}+)$", "e$1"))

    ready = let(marked(word), lambda w: F.struct(w.alias("w"), _regions(w).alias("at")))
    return let(let(ready, with_regions), finish)
