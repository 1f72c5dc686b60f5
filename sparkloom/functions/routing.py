"""Queries as columns: normalisation, entities, time ranges, routes, namespaces, safety and scope.

Every function takes and gives Columns, so a table of queries is routed in one projection.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import ascii_edges, collapse, found


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(ascii_edges(pattern)), F.lit(False))


def normalize(query: Column) -> Column:
    """White space joined, abbreviations written out in order, then lower case."""
    text = collapse(query)
    for pattern, words, case in V.REWRITES:
        text = F.regexp_replace(text, ascii_edges(pattern if case else f"(?i){pattern}"), words)
    return F.lower(text)


def expansions(query: Column) -> Column:
    """The words that each applicable rewrite put in, in order."""
    text, out = collapse(query), []
    for pattern, words, case in V.REWRITES:
        p = ascii_edges(pattern if case else f"(?i){pattern}")
        out.append(F.when(has(text, p), F.concat(F.regexp_extract(text, p, 0), F.lit(f" → {words}"))))
        text = F.regexp_replace(text, p, words)
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _surfaces(table: dict, extra: dict) -> dict[str, str]:
    out = {}
    for key, spec in table.items():
        out[key] = key
        out.update({a: key for a in spec[-1].split("|") if len(a) >= 3})
    return out | extra


LEXICON = {
    "drugs": {d: d for d in V.DRUGS},
    "labs": _surfaces(V.LABS, V.MORE_LABS),
    "conditions": _surfaces(V.CONDITIONS, V.MORE_CONDITIONS),
}


def brand_lexicon(brands: dict[str, str]) -> dict[str, str]:
    """Brand name -> drug, of names of four letters or more without digits. A catalogue, read by the driver."""
    return {b.lower(): d for b, d in brands.items() if len(b) >= 4 and not any(c.isdigit() for c in b)}


def lexicon(kind: str, brands: dict[str, str] | None = None) -> dict[str, str]:
    """Surface form -> canonical key; own names win over brands."""
    return (brand_lexicon(brands) if brands and kind == "drugs" else {}) | LEXICON[kind]


def gazetteer(kind: str, brands: dict[str, str] | None = None) -> str:
    """One alternation of all surface forms, longest first, so that the longest match wins."""
    return r"\b(" + "|".join(re.escape(s) for s in sorted(lexicon(kind, brands), key=len, reverse=True)) + r")\b"


def _sorted_set(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def mentioned(kind: str, normalized: Column, brands: dict[str, str] | None = None) -> Column:
    """Sorted canonical keys of one kind that a normalised query names."""
    named = F.create_map(*[F.lit(x) for pair in lexicon(kind, brands).items() for x in pair])
    keys = _sorted_set(F.transform(found(normalized, gazetteer(kind, brands), 1), lambda s: F.element_at(named, s)))
    if kind != "labs":
        return keys
    both = F.array_contains(keys, "systolic blood pressure") & normalized.contains("blood pressure") & ~normalized.contains("systolic")
    return F.when(both, F.array_sort(F.array_union(keys, F.array(F.lit("diastolic blood pressure"))))).otherwise(keys)


def patient_ids(query: Column) -> Column:
    return _sorted_set(F.transform(found(query, V.PATIENT_ID, 1), lambda d: F.concat(F.lit("P"), d)))


def rxcuis(query: Column) -> Column:
    return _sorted_set(found(query, V.RXCUI, 1))


def icd_codes(query: Column, known: list[str] | None = None) -> Column:
    """Codes that are known, have a dot, or stand in a query about codes."""
    context = has(query, V.ICD_CONTEXT)
    fits = lambda c: context | c.contains(".") | (c.isin(*known) if known else F.lit(False))
    return _sorted_set(F.filter(found(query, V.ICD_CODE, 1), fits))


def record_types(normalized: Column) -> Column:
    return F.filter(F.array(*[F.when(has(normalized, p), F.lit(k)) for k, p in sorted(V.RECORD_TYPES.items())]), lambda x: x.isNotNull())


def time_range(normalized: Column, today: dt.date) -> Column:
    """struct(text, start, end, latest_only): last N units, since a year, in a year, this year, or the latest."""
    day = F.lit(today)
    match = lambda p, g: F.nullif(F.regexp_extract(normalized, ascii_edges(p), g), F.lit(""))
    words = F.create_map(*[F.lit(x) for pair in V.NUMBER_WORDS.items() for x in pair])
    units = F.create_map(*[F.lit(x) for pair in V.UNIT_DAYS.items() for x in pair])
    n = F.coalesce(match(V.RELATIVE, 1).try_cast("int"), F.element_at(words, F.coalesce(match(V.RELATIVE, 1), F.lit("one"))), F.lit(1))
    none = F.lit(None).cast("date")
    made = lambda text, a, b, latest=False: F.struct(text.alias("text"), a.alias("start"), b.alias("end"), F.lit(latest).alias("latest_only"))
    since, during = r"\bsince\s+(20\d\d)\b", r"\b(?:in|during)\s+(20\d\d)\b"
    year = lambda p, month, d: F.make_date(match(p, 1).cast("int"), F.lit(month), F.lit(d))
    newest = r"\b(latest|most recent|last|current|recent|newest)\b"
    return (
        F.when(has(normalized, V.RELATIVE), made(match(V.RELATIVE, 0), F.date_sub(day, n * F.element_at(units, match(V.RELATIVE, 2))), day))
        .when(has(normalized, since), made(match(since, 0), year(since, 1, 1), day))
        .when(has(normalized, during), made(match(during, 0), year(during, 1, 1), year(during, 12, 31)))
        .when(has(normalized, r"\bthis year\b"), made(F.lit("this year"), F.lit(dt.date(today.year, 1, 1)), day))
        .when(has(normalized, newest), made(match(newest, 0), none, none, True))
    )


def negated(kind: str, normalized: Column, brands: dict[str, str] | None = None) -> Column:
    """Keys of one kind with a negation in the 40 characters before them and at most four words between.

    A lookbehind of fixed reach cannot hold the words between, so each mention is found with what stands before it: the
    text is cut behind every mention, and the pieces up to 40 characters back are looked at."""
    named = F.create_map(*[F.lit(x) for pair in lexicon(kind, brands).items() for x in pair])
    marked = F.regexp_replace(normalized, ascii_edges(gazetteer(kind, brands)), "\u0001$1\u0002")
    pieces = F.split(marked, "\u0002", -1)  # every piece but the last ends with a mention
    # What stands before a mention is its own piece and, if that is short, the ends of those before.
    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(
        F.split_part(p, F.lit("\u0001"), F.lit(2)).alias("s"),
        F.right(F.concat(F.array_join(F.transform(F.slice(pieces, F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))), lambda q: F.right(F.replace(q, F.lit("\u0001"), F.lit("")), F.lit(40))), ""), F.split_part(p, F.lit("\u0001"), F.lit(1))), F.lit(40)).alias("w"),
    ))

    def hit(x: Column) -> Column:
        gap = F.regexp_extract(x["w"], ascii_edges(r"(?s).*" + V.NEGATION + r"(.*)$"), 2)
        return F.when(has(x["w"], V.NEGATION) & (F.size(F.filter(F.split(F.trim(gap), r"\s+"), lambda w: w != "")) <= 4), F.element_at(named, x["s"]))

    return _sorted_set(F.filter(F.transform(before, hit), lambda k: k.isNotNull()))


def entities(query: Column, normalized: Column, today: dt.date, known_codes: list[str] | None = None, brands: dict[str, str] | None = None, near_drugs: Column | None = None) -> Column:
    """What a query names. ``known_codes`` count as codes in any context, ``brands`` as their drugs, and ``near_drugs`` (names that are
    nearly spelled, see ``fuzzy``) join the drugs."""
    drugs = mentioned("drugs", normalized, brands)
    return F.struct(
        patient_ids(query).alias("patient_ids"), icd_codes(query, known_codes).alias("icd10_codes"), rxcuis(query).alias("rxnorm_codes"),
        (drugs if near_drugs is None else _sorted_set(F.array_union(drugs, near_drugs))).alias("drugs"), mentioned("labs", normalized).alias("labs"), mentioned("conditions", normalized).alias("conditions"),
        time_range(normalized, today).alias("time_range"), record_types(normalized).alias("record_types"), has(normalized, V.DOSAGE).alias("dosage_intent"),
        _sorted_set(F.array_union(negated("drugs", normalized, brands), negated("conditions", normalized))).alias("negated_terms"),
    )


def route(normalized: Column, e: Column, scope: Column) -> Column:
    """struct(route, confidence): KV, VECTOR or HYBRID, first rule that fits."""
    some = lambda f: F.size(e[f]) > 0
    patient = some("patient_ids") | scope.isNotNull()
    code = some("icd10_codes") | some("rxnorm_codes")
    knowledge = has(normalized, V.KNOWLEDGE) & ~(code & ~patient & has(normalized, V.DEFINITION))
    narrative = patient & has(normalized, V.NARRATIVE)
    lookup = has(normalized, V.LOOKUP)
    structured = (
        code | some("record_types") | (patient & (some("labs") | (some("drugs") & (lookup | e["dosage_intent"])))) | (~patient & some("drugs") & has(normalized, V.IDENTIFIER))
    )
    out = lambda r, c: F.struct(F.lit(r).alias("route"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    pick = lambda test, yes, no: F.when(test, yes).otherwise(no)
    return (
        F.when(structured & (knowledge | narrative), out("HYBRID", pick(knowledge, 0.85, 0.75)))
        .when(structured, out("KV", pick(code | some("record_types") | lookup, 0.92, 0.78)))
        .when(narrative, out("VECTOR", 0.85))
        .when(knowledge & patient, out("HYBRID", 0.72))
        .when(knowledge | some("drugs") | some("conditions"), out("VECTOR", pick(knowledge, 0.88, 0.70)))
        .when(patient, out("HYBRID", 0.50))
        .otherwise(out("VECTOR", 0.45))
    )


def namespaces(normalized: Column, e: Column, scope: Column) -> Column:
    """Namespaces to search, in order."""
    some = lambda f: F.size(e[f]) > 0
    scoped, drugish = scope.isNotNull(), has(normalized, V.DRUG_WORDS)
    notes, labels, topics = F.lit("patient_notes"), F.lit("drug_labels"), F.lit("guidelines")
    only_notes = scoped & has(normalized, V.NOTES_ONLY) & ~(has(normalized, V.KNOWLEDGE) | drugish)
    wants_labels = some("drugs") | drugish
    listed = F.array(
        F.when(~scoped & ~wants_labels, labels), F.when(scoped, notes), F.when(wants_labels, labels), F.when(some("conditions") | ~some("drugs") | ~scoped, topics)
    )
    return F.when(only_notes, F.array(notes)).otherwise(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())))


def red_flag_categories(query: Column) -> Column:
    text = collapse(query)
    hits = [F.when(reduce(lambda a, b: a | b, [has(text, f"(?i){p}") for p in ps]), F.lit(c)) for c, ps in V.RED_FLAGS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def looks_clinical(query: Column) -> Column:
    names = sorted({*V.DRUGS, *V.LABS, *V.CONDITIONS, *(a for _, al in V.CONDITIONS.values() for a in al.split("|") if len(a) >= 3)}, key=len, reverse=True)
    return has(query, f"(?i){V.MEDICAL_HINT}") | has(query, r"(?i)\b(" + "|".join(re.escape(n) for n in names) + r")\b")


def precheck(query: Column, clinical_context: Column) -> Column:
    """struct(verdict, category): red_flag, ok or out_of_scope, before anything is retrieved."""
    text, hits = collapse(query), red_flag_categories(query)
    framed = has(text, f"(?i){V.RECORD_FRAME}") & ~has(text, f"(?i){V.FIRST_PERSON}") & ~has(text, f"(?i){V.URGENT}")
    out = lambda v, c: F.struct(F.lit(v).alias("verdict"), c.alias("category"))
    none = F.lit(None).cast("string")
    first = F.when(F.array_contains(hits, "self_harm"), F.lit("self_harm")).otherwise(F.get(hits, F.lit(0)))
    return (
        F.when(F.size(hits) > 0, F.when(framed, out("ok", F.lit("record_query_on_red_flag_topic"))).otherwise(out("red_flag", first)))
        .when(~clinical_context & ~looks_clinical(text), out("out_of_scope", F.lit("non_clinical")))
        .otherwise(out("ok", none))
    )


def scope_of(request: Column, named: Column, known: Column) -> Column:
    """struct(scope, violation). ``known`` says whether the resulting id exists."""
    ids = _sorted_set(named)
    chosen = F.coalesce(request, F.get(ids, F.lit(0)))
    out = lambda s, v: F.struct(s.alias("scope"), v.alias("violation"))
    none = F.lit(None).cast("string")
    return (
        F.when(F.size(ids) > 1, out(none, F.lit("several")))
        .when(request.isNotNull() & (F.size(ids) > 0) & (F.get(ids, F.lit(0)) != request), out(none, F.lit("mismatch")))
        .when(chosen.isNotNull() & ~F.coalesce(known, F.lit(False)), out(none, F.lit("unknown")))
        .otherwise(out(chosen, none))
    )


def cache_key(normalized: Column, scope: Column, filters: Column, spaces: Column, options: Column, version: Column) -> Column:
    """Exact result-cache key: a digest of everything that decides an answer, under the scope."""
    payload = F.concat_ws("\u0001", F.lower(collapse(normalized)), F.coalesce(scope, F.lit("")), F.coalesce(filters, F.lit("")), F.array_join(F.array_sort(spaces), ","), F.coalesce(options, F.lit("")), version.cast("string"))
    return F.concat(F.lit("ans:"), F.coalesce(scope, F.lit("global")), F.lit(":"), F.substring(F.sha2(payload, 256), 1, 32))


def request_problem(query: Column, scope: Column, top_k: Column) -> Column:
    """The first fault of a request, or null."""
    return (
        F.when(query.isNull() | (F.length(F.trim(query)) < 1), "query is empty").when(F.length(query) > 2000, "query is too long")
        .when(scope.isNotNull() & ~scope.rlike(r"^P\d{4,6}$"), "scope is malformed").when((top_k < 1) | (top_k > 20), "top_k is out of range")
    )
