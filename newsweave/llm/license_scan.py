"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is normalised (lower case, runs of other characters than letters and digits become one mark), with
three marks: between words, at a possible sentence end (line ends, and white space after ``.``, ``!``, ``?``
or ``:``) and at a blank line. A known licence sentence is found where its words stand between two ends, also
when it is wrapped over lines, with or without comment leaders, but not across a blank line; of two that
begin at one place the longer counts. A document's identifiers, in text order, are then matched against
rules: a rule holds when its identifiers occur in its order, other sentences may lie between. A licence that
is part of another one's text (``PART_OF``) is not named beside it, nor where the other's further sentence begins in unknown
words. Sentences have slots where licences name a holder, so any holder's name counts; an identifier line with
``OR``, ``AND`` or ``WITH`` names each of its licences.

Scale. Everything happens inside a row, so there is no shuffle and no join. Texts without any of the anchor
words (few words, one of which every known sentence has) are not searched at all, which loses nothing.

Edge cases. Null and empty texts have no sentence. Repeated sentences are listed each time; repeated
rows are judged each. Null ids, extra columns and empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.license_texts import PART_OF, RULES, SENTENCES
from newsweave.llm.words import LOWER, UPPER, bind, lower_ascii


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _cover(sentences: list[str], least: int = 6) -> list[str]:
    """Few words of ``least`` letters or more, one of which every sentence has."""
    left, words = [set(x for x in s.split() if len(x) >= least) for s in sentences], []
    while left:
        words.append(max(sorted({x for s in left for x in s}), key=lambda x: sum(x in s for s in left)))
        left = [s for s in left if words[-1] not in s]
    return words


KNOWN = {_plain(text): name for name, text in SENTENCES.items()}
ANCHORS = _cover(list(KNOWN))
# Capitals cannot occur in the lower-cased text: S is a possible sentence end, H a blank line or an end of the text.
PATTERN = "(?<=[SH])(" + "|".join(text.replace(" ", "[ S]") for text in sorted(KNOWN, key=len, reverse=True)) + ")(?=[SH])"
_OPERATOR = (r"(spdx-license-identifier:[^\n]*?)[\x20\x09()]+(?:or|and)[\x20\x09(]+([a-z0-9])", "$1\nspdx-license-identifier: $2")
TERMS = 4  # operators in one identifier line
_WORDS = r"(?:[a-z0-9]+[ S]){1,15}?"
_BY = "neither the name of the copyright holder nor the names of its contributors"
STEPS = (
    # an identifier line with operators names each of its licences, exceptions aside
    (r"(spdx-license-identifier:[^\n]*?)[\x20\x09]+with[\x20\x09]+[a-z0-9.-]+", "$1"),
    *[_OPERATOR] * TERMS,
    (r"\n(?:[^a-z0-9\n]*\n)+", "H"),
    (r"([.!?:])[\x20\x09-\x0D]+", "$1S"),
    (r"\n", "S"),
    (r"[^a-z0-9SH]+", " "),
    (r" ?S[ S]*", "S"),
    (r" ?S?H[ SH]*", "H"),
    # slots: whoever's name must not be used
    (rf"neither[ S]the[ S]names?[ S]of[ S]{_WORDS}nor[ S]the[ S]names?[ S]of[ S](?:its[ S]|their[ S]|the[ S])?contributors", _BY),
    (rf"the[ S]names?[ S]of[ S]{_WORDS}may[ S]not[ S]be[ S]used[ S]to[ S]endorse", _BY + " may be used to endorse"),
)
# A licence that is part of another is not named either where the other's further sentence is begun in words that are not known.
BEGUN = "[SH]neither the name"


def _marked(text: Column) -> Column:
    """The words of ``text`` with one space, ``S`` or ``H`` between them, and ``H`` at both ends."""
    marked = F.concat(F.lit("H"), lower_ascii(text), F.lit("H"))
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    return marked


def _found(text: Column) -> Column:
    """The identifiers of the known sentences of ``text`` in order (``ids``), and whether a longer licence is begun (``begun``)."""
    known = F.create_map(*[F.lit(x) for item in KNOWN.items() for x in item])
    low = lower_ascii(text)
    anchored = F.lit(False)
    for word in ANCHORS:
        anchored = anchored | F.contains(low, F.lit(word))

    def read(marked: Column) -> Column:
        ids = F.transform(F.regexp_extract_all(marked, F.lit(PATTERN), F.lit(1)), lambda s: F.element_at(known, F.translate(s, "S", " ")))
        return F.struct(ids.alias("ids"), marked.rlike(BEGUN).alias("begun"))

    none = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(False).alias("begun"))
    return F.when(anchored, bind(_marked(text), read)).otherwise(none)


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of ``text``, in order."""
    return _found(text)["ids"]


def _holds(ids: Column, rule: tuple[str, ...]) -> Column:
    wanted = F.array(*map(F.lit, rule))
    return F.aggregate(ids, F.lit(0), lambda at, s: at + F.when(s == F.get(wanted, at), 1).otherwise(0)) == len(rule)


def licences(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences`` (both joined by commas) for each row of ``docs``."""
    rows = docs.select("doc_id", bind(_found(F.coalesce("text", F.lit(""))), lambda x: x).alias("f")).select("doc_id", "f.ids", "f.begun")
    names = F.array(*[F.when(_holds(F.col("ids"), ids), F.lit(name)) for name, ids in RULES])
    whole = F.create_map(*[F.lit(x) for item in PART_OF.items() for x in item])

    def stands(found: Column, name: Column) -> Column:
        larger = F.try_element_at(whole, name)
        return ~F.coalesce(F.array_contains(found, larger) | F.col("begun"), F.lit(False)) | larger.isNull()

    alone = bind(F.array_sort(F.array_distinct(F.array_compact(names))), lambda found: F.filter(found, lambda n: stands(found, n)))
    held = F.when(F.size("ids") == 0, F.lit("")).otherwise(F.array_join(alone, ","))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), held.alias("licences"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _marked_sql() -> str:
    marked = f"'H' || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || 'H'"
    for pattern, to in STEPS:
        marked = f"regexp_replace({marked}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return marked


ORACLE_SQL = f"""
WITH known(plain, name) AS (VALUES {_values(list(KNOWN.items()))}),
rules(licence, steps) AS (VALUES {_values([(lic, "%" + "%".join(f",{n}," for n in ids) + "%") for lic, ids in RULES])}),
part_of(part, whole) AS (VALUES {_values(list(PART_OF.items()))}),
t AS MATERIALIZED (SELECT doc_id, {_marked_sql()} AS marked FROM documents WHERE regexp_matches(lower(text), '{"|".join(ANCHORS)}')),
m AS (SELECT doc_id, string_split(marked, 'H') AS blocks FROM t), begun AS (SELECT doc_id FROM t WHERE regexp_matches(marked, '{BEGUN}')),
b AS (SELECT doc_id, unnest(range(len(blocks))) AS block, unnest(blocks) AS words FROM m),
p AS (SELECT doc_id, block, string_split(words, 'S') AS parts FROM b WHERE words <> ''),
i AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p),
j AS (SELECT *, unnest(range(i, least(len(parts), i + {max(len(k.split()) for k in KNOWN)}) + 1)) AS j FROM i),
found AS (SELECT doc_id, block, i, j, name FROM j JOIN known ON plain = array_to_string(parts[i:j], ' ')),
hit AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.block = f.block AND g.i <= f.i AND g.j >= f.j AND g.j - g.i > f.j - f.i)),
ids AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY block, i) AS ids, string_agg(',' || name || ',', '' ORDER BY block, i) AS run FROM hit GROUP BY doc_id),
held AS (SELECT DISTINCT doc_id, licence FROM ids JOIN rules ON run LIKE steps),
alone AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM part_of JOIN held w ON w.licence = whole WHERE part = h.licence AND w.doc_id = h.doc_id)
  AND NOT (licence IN (SELECT part FROM part_of) AND doc_id IN (SELECT doc_id FROM begun))),
lic AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM alone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id LEFT JOIN lic ON d.doc_id = lic.doc_id
"""
