"""Entity-name normal forms and the fuzzy verifier.

The plain functions on two strings define the rules; ``fuzzy_names`` and ``edit_key_columns`` are the same rules as
columns, which queries use.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsweave.functions import porter2
from newsweave.functions.spelling import jaro_winkler_similarity, spelling  # noqa: F401

stem = functools.lru_cache(maxsize=1 << 16)(porter2.stem)  # a token is stemmed once in a worker

NUMERIC = r"\p{N}"

# Thresholds and spelling variants per entity type.
JARO_WINKLER = {"PERSON": 0.90, "ORGANIZATION": 0.85, "LOCATION": 0.85, "PRODUCT": 0.80}
EDITS = {"PERSON": 2, "ORGANIZATION": 3, "LOCATION": 3, "PRODUCT": 3}
VARIANTS = (
    ("project", "projekt"), ("center", "centre"), ("defense", "defence"), ("program", "programme"),
    ("color", "colour"), ("theater", "theatre"), ("organization", "organisation"), ("analyzer", "analyser"),
)


def basic_form(name: str, strip_marks: bool = True) -> str:
    """Without possessives and punctuation, in compatibility form and lower case, single spaces."""
    for old, new in (("'s ", " "), ("'s", ""), ("s' ", "s "), ("' ", " "), ("'", "")):
        name = name.replace(old, new)
    name = unicodedata.normalize("NFKD", name)
    if strip_marks:
        name = "".join(c for c in name if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def normal_form(name: str, kind: str, strip_marks: bool = True) -> str:
    """The basic form; stemmed and with the first known spelling variant for products and organisations."""
    form = basic_form(name, strip_marks)
    if kind not in ("PRODUCT", "ORGANIZATION"):
        return form
    form = " ".join(map(stem, form.split()))
    return next((form.replace(a, b) for a, b in VARIANTS if a in form), form)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common prefix of up to four characters where it exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + (0.1 * prefix * (1 - jaro) if jaro > 0.7 else 0.0)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def _numeric(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "N" for c in text)


def _size(text: str) -> int:
    return len(text.encode())


def _contained(short: str, long: str, kind: str) -> bool | None:
    """What containment of ``short`` in ``long`` says about products and organisations; None: nothing."""
    tokens, others = set(short.split()), set(long.split())
    single = len(tokens) == 1
    if single and _size(short) < 5:
        return False
    organisation = kind == "ORGANIZATION"
    if organisation and single and long.startswith(short) and long != short and long[len(short)] != " ":
        return False
    if organisation and single and _size(short) <= 5:
        initials = "".join(w[0] for w in long.split())
        return True if short in initials or short in others or long.startswith(short) else None
    if kind == "PRODUCT" and _size(short) > 3:
        return True
    if organisation and tokens <= others and (len(tokens) > 1 or _size(short) >= _size(long) // 2):
        return True
    return None


def _close_spelling(a: str, b: str, kind: str) -> bool:
    limit = EDITS.get(kind, 2)
    if abs(_size(a) - _size(b)) > limit or edit_distance(a, b) > limit:
        return False
    longest = max(_size(a), _size(b))
    if longest <= 15 or (_numeric(a) and _numeric(b)):
        return True
    shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if kind == "PRODUCT" and shared:
        tail_a, tail_b = a[shared:].strip(), b[shared:].strip()
        if min(_size(tail_a), _size(tail_b)) > 3 and edit_distance(tail_a, tail_b) > 2:
            return False
    return shared >= longest // 3


def edit_keys(form: str, kind: str, left: bool) -> list[str]:
    """Keys of which a left and a right form within the edit limit share one at least, where no long common start is asked for.

    A left form is cut into one segment more than edits are allowed, so one of them is left whole; a right form
    gives the pieces that may be such a segment of a form of any length in reach.
    """
    limit = EDITS.get(kind, 2)
    if _size(form) > 15 and not _numeric(form):
        return []
    keys = set()
    for n in [len(form)] if left else range(max(1, len(form) - limit), len(form) + limit + 1):
        for i in range(limit + 1):
            begin, end = i * n // (limit + 1), (i + 1) * n // (limit + 1)
            for shift in [0] if left else range(-limit, limit + 1):
                if begin + shift >= 0 and end + shift <= len(form):
                    keys.add(f"s:{limit}:{n}:{i}:{form[begin + shift : end + shift]}")
    return sorted(keys)


def fuzzy_match(a: str, b: str, raw_a: str, raw_b: str, kind: str) -> bool:
    """Whether two normal forms (with their raw names) name one entity: a chain of type-specific evidence."""
    words_a, words_b = a.split(), b.split()
    if kind == "LOCATION" and len(set(words_a)) != len(set(words_b)):
        return False
    if kind == "PRODUCT" and len(words_a) > 1 and len(words_b) > 1 and words_a[0] == words_b[0]:
        last_a, last_b = words_a[-1], words_b[-1]
        if last_a != last_b and min(_size(last_a), _size(last_b)) > 3 and edit_distance(last_a, last_b) > 2:
            return False
    if kind in ("PRODUCT", "ORGANIZATION"):
        first_short = _size(a) < _size(b)
        short, long, raw = (a, b, raw_a) if first_short else (b, a, raw_b)
        if kind == "ORGANIZATION" and all("A" <= c <= "Z" for c in raw):
            if short in long.split() or long.startswith(short + " ") or short in "".join(w[0] for w in long.split()):
                return True
        if short in long:
            verdict = _contained(short, long, kind)
            if verdict is not None:
                return verdict
    if kind == "PERSON":
        for x, y in ((a, b), (b, a)):
            if x.endswith("s") and _size(x) > _size(y) and x.startswith(y):
                return False
    return jaro_winkler(a, b) >= JARO_WINKLER.get(kind, 0.85) or _close_spelling(a, b, kind)


def names_match(name1: str, name2: str, kind: str) -> bool:
    a, b = normal_form(name1, kind), normal_form(name2, kind)
    return a == b or fuzzy_match(a, b, name1, name2, kind)


@F.pandas_udf(StringType())
def normalize_name(name: pd.Series, kind: pd.Series) -> pd.Series:
    """Normal forms; a name that a batch holds several times is normalised once."""
    pairs = pd.MultiIndex.from_arrays([name, kind])
    codes, distinct = pairs.factorize()
    forms = np.array([None if n is None or n != n else normal_form(n, k if isinstance(k, str) and k else "OTHER") for n, k in distinct], dtype=object)
    return pd.Series(forms[codes] if len(forms) else [], dtype=object)


def edit_key_columns(normal: Column, kind: Column, left: bool) -> Column:
    """``edit_keys`` as built-in functions."""
    limit = F.when(kind.isin([k for k, v in EDITS.items() if v == 3]), 3).otherwise(2)
    size = F.length(normal)

    def cuts(n: Column) -> Column:
        def pieces(i: Column) -> Column:
            begin, end = F.floor(i * n / (limit + 1)).cast("int"), F.floor((i + 1) * n / (limit + 1)).cast("int")
            shifts = F.array(F.lit(0)) if left else F.sequence(-limit, limit)
            fits = F.filter(shifts, lambda s: (begin + s >= 0) & (end + s <= size))
            return F.transform(fits, lambda s: F.concat_ws(":", F.lit("s"), limit.cast("string"), n.cast("string"), i.cast("string"), F.substr(normal, begin + s + 1, end - begin)))

        return F.flatten(F.transform(F.sequence(F.lit(0), limit), pieces))

    lengths = F.array(size) if left else F.sequence(F.greatest(F.lit(1), size - limit), size + limit)
    asked = (F.octet_length(normal) <= 15) | normal.rlike(NUMERIC)
    return F.when(asked, F.array_distinct(F.flatten(F.transform(lengths, cuts)))).otherwise(F.array().cast("array<string>"))


def fuzzy_names(a: Column, b: Column, raw_a: Column, raw_b: Column, kind: Column) -> Column:
    """``fuzzy_match`` as a column: built-in functions, with the spelling measures of a whole batch in numpy."""
    bytes_ = F.octet_length
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    last = lambda x: F.element_at(words(x), -1)
    initials = lambda x: F.array_join(F.transform(words(x), lambda w: F.substring(w, 1, 1)), "")
    product, organisation = kind == "PRODUCT", kind == "ORGANIZATION"

    places = (kind == "LOCATION") & (F.size(F.array_distinct(words(a))) != F.size(F.array_distinct(words(b))))
    several = (F.size(words(a)) > 1) & (F.size(words(b)) > 1) & (F.try_element_at(words(a), F.lit(1)) == F.try_element_at(words(b), F.lit(1)))
    far_ends = (last(a) != last(b)) & (F.least(bytes_(last(a)), bytes_(last(b))) > 3) & (F.levenshtein(last(a), last(b)) > 2)
    models = product & several & F.when(several, far_ends)

    first_short = bytes_(a) < bytes_(b)
    short, long, raw = (F.when(first_short, x).otherwise(y) for x, y in ((a, b), (b, a), (raw_a, raw_b)))
    acronym = organisation & raw.rlike(r"\A[A-Z]*\z") & (F.array_contains(words(long), short) | long.startswith(F.concat(short, F.lit(" "))) | F.contains(initials(long), short))
    single = F.size(F.array_distinct(words(short))) == 1
    follows = F.substr(long, F.length(short) + 1, F.lit(1))
    brief = F.contains(initials(long), short) | F.array_contains(words(long), short) | long.startswith(short)
    covered = (F.size(F.array_except(words(short), words(long))) == 0) & ((F.size(F.array_distinct(words(short))) > 1) | (bytes_(short) >= F.floor(bytes_(long) / 2)))
    held = (
        F.when(single & (bytes_(short) < 5), False)
        .when(organisation & single & long.startswith(short) & (long != short) & (follows != " "), False)
        .when(organisation & single & (bytes_(short) <= 5), F.when(brief, True))
        .when(product & (bytes_(short) > 3), True)
        .when(organisation & covered, True)
    )
    contained = F.when((product | organisation) & F.contains(long, short), held)
    plural = lambda x, y: x.endswith("s") & (bytes_(x) > bytes_(y)) & x.startswith(y)
    people = (kind == "PERSON") & (plural(a, b) | plural(b, a))

    limit = F.when(kind.isin([k for k, v in EDITS.items() if v == 3]), 3).otherwise(2)
    floor = F.when(kind == "PERSON", JARO_WINKLER["PERSON"]).when(product, JARO_WINKLER["PRODUCT"]).otherwise(0.85)
    longest = F.greatest(bytes_(a), bytes_(b))

    def by_spelling(m: Column) -> Column:
        tail = lambda x: F.trim(F.substr(x, m["start"] + 1, F.length(x)))
        torn = product & (m["start"] > 0) & (F.least(bytes_(tail(a)), bytes_(tail(b))) > 3) & (F.levenshtein(tail(a), tail(b)) > 2)
        near = (F.abs(bytes_(a) - bytes_(b)) <= limit) & (m["edits"] <= limit)
        free = (longest <= 15) | (a.rlike(NUMERIC) & b.rlike(NUMERIC))
        return (m["similarity"] >= floor) | (near & (free | (~torn & (m["start"] >= F.floor(longest / 3)))))

    close = F.transform(F.array(spelling(a, b)), by_spelling)[0]
    verdict = F.when(places | F.coalesce(models, F.lit(False)), False).when(acronym, True).when(contained.isNotNull(), contained).when(people, False).otherwise(close)
    return F.coalesce(verdict, F.lit(False))


def settled(a: Column, b: Column, kind: Column) -> Column:
    """What built-in functions can tell about two different normal forms of people, places and the like: true, false, or null.

    Forms within the edit limit match, unless a type-specific rule rejects them; forms whose lengths and common
    start keep them below the Jaro-Winkler threshold do not. Products and organisations have further evidence
    and are left open, and so is everything in between.
    """
    simple = ~kind.isin("PRODUCT", "ORGANIZATION")
    limit = F.when(kind == "LOCATION", EDITS["LOCATION"]).otherwise(2)
    words = lambda x: F.size(F.array_distinct(F.split(x, " ")))
    other_size = (kind == "LOCATION") & (words(a) != words(b))
    plural = lambda x, y: x.endswith("s") & x.startswith(y) & (F.octet_length(x) > F.octet_length(y))
    rejected = other_size | ((kind == "PERSON") & (plural(a, b) | plural(b, a)))
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    near = (F.abs(F.octet_length(a) - F.octet_length(b)) <= limit) & F.when(kind == "LOCATION", F.levenshtein(a, b, EDITS["LOCATION"]) >= 0).otherwise(F.levenshtein(a, b, 2) >= 0)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    same = lambda n: (F.left(a, F.lit(n)) == F.left(b, F.lit(n))).cast("int")
    start = F.least(same(1) + same(2) + same(3) + same(4), F.least(F.length(a), F.length(b)))
    jaro = (2 + ratio) / 3
    most = jaro + 0.1 * start * (1 - jaro)
    threshold = F.when(kind == "PERSON", JARO_WINKLER["PERSON"]).otherwise(0.85)
    return F.when(simple & rejected, False).when(simple & near & (longest <= 15), True).when(simple & ~near & (most < threshold - 1e-9), False)


def compatible_types(a: Column, b: Column) -> Column:
    """Equal types, or a product and an organisation."""
    pair = ("PRODUCT", "ORGANIZATION")
    return (a == b) | (a.isin(*pair) & b.isin(*pair))
