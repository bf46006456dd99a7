"""Redaction expressions: contacts, labelled values, known people and the clinical invariants."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliarc import vocab
from foliarc.functions.text import fold_case, let, letters, quoted, strip, words

_PERSON = "struct<at:int,kind:string,name:string>"
_PAIRS = "array<struct<k:string,v:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern if "(" in pattern else f"({pattern})"), group)


def mask_contacts(text: Column) -> Column:
    """E-mail, phone, internal ids, paths, file names and labelled locations, in this order."""
    def masked(pattern: str, label: str, signs: str):
        # A text without any of the characters that a match must hold is passed on unsearched.
        def rule(t: Column) -> Column:
            return F.when(reduce(or_, [F.contains(t, F.lit(sign)) for sign in signs]), F.regexp_replace(t, pattern, label)).otherwise(t)
        return rule

    for pattern, label in vocab.CONTACT_RULES:
        signs = vocab.CONTACT_SIGNS.get(pattern)
        text = let(text, masked(pattern, label, signs)) if signs else F.regexp_replace(text, pattern, label)
    return text


# ---- people ------------------------------------------------------------------------------
def _located(text: Column, pattern: str, group: int, kind: Column | None, label_group: int | None = None) -> Column:
    """{at, kind, name} of every match; positions come from the text between the matches."""
    whole = matches(text, pattern)
    names = matches(text, pattern, group)
    labels = matches(text, pattern, label_group) if label_group else names
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("whole"), names.alias("name"), labels.alias("label"),
                          F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PERSON}>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        at = state["at"] + F.length(item["gap"])
        who = kind if kind is not None else F.when(
            fold_case(item["label"]).isin(vocab.DOCTOR_LABELS), F.lit("DOCTOR")).otherwise(F.lit("PERSON"))
        person = F.struct(at.alias("at"), who.alias("kind"), item["name"].alias("name"))
        return F.struct((at + F.length(item["whole"])).alias("at"),
                        F.concat(state["out"], F.array(person)).cast(f"array<{_PERSON}>").alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(
        F.array().cast(f"array<{_PERSON}>"))


def people(text: Column) -> Column:
    """People named after a label, with a patronymic, initials or an honorific, in reading order."""
    found = [_located(text, vocab.PERSON_LABEL, 2, None, 1)]
    found += [_located(text, pattern, 1, F.lit(kind)) for kind, pattern in vocab.UNLABELLED_NAMES]
    return F.sort_array(F.concat(*found))


def _value(pairs: Column, key: Column) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def _add(pairs: Column, keys: Column, value: Column) -> Column:
    fresh = F.filter(F.array_distinct(keys), lambda k: ~F.exists(pairs, lambda p: p["k"] == k))
    return F.concat(pairs, F.transform(fresh, lambda k: F.struct(k.alias("k"), value.alias("v")))).cast(_PAIRS)


def _safe_part(part: Column) -> Column:
    """A lone name part is hidden only when it cannot be an ordinary or medical word."""
    head = F.substring(part, 1, 1)
    return (F.length(part) >= 3) & (F.upper(head) == head) & (F.lower(head) != head) & ~fold_case(part).isin(
        vocab.NAME_STOPLIST)


def aliases(found: Column, known: Column | None = None) -> Column:
    """{phrases, words}: replacement pairs; a person keeps one placeholder over all spellings. ``known`` ones go on."""

    def step(state: Column, person: Column) -> Column:
        def of_name(name: Column) -> Column:
            parts = F.filter(words(name), lambda w: ~w.rlike(vocab.HONORIFIC) & ~w.rlike(vocab.INITIALS))

            def of_parts(p: Column) -> Column:
                first = F.get(p, F.lit(0))
                second = F.when(name.rlike("[А-Яа-яЁё]"), F.get(p, F.lit(1))).otherwise(F.element_at(p, -1))
                variants = F.when(F.size(p) >= 2, F.array(
                    name, F.concat_ws(" ", first, second), F.concat_ws(" ", second, first))).otherwise(F.array(name))

                def assign(v: Column) -> Column:
                    known = F.get(F.filter(F.flatten(F.transform(v, lambda x: F.array(
                        _value(state["phrases"], fold_case(x)), _value(state["words"], x)))),
                        lambda x: x.isNotNull()), F.lit(0))
                    taken = F.size(F.array_distinct(F.transform(F.concat(state["phrases"], state["words"]), lambda x: x["v"])))
                    fresh = F.concat(F.lit("["), person["kind"], F.lit("_"), letters(taken), F.lit("]"))
                    many = F.transform(F.filter(v, lambda x: F.contains(x, F.lit(" "))), fold_case)
                    single = F.concat(F.filter(v, lambda x: ~F.contains(x, F.lit(" ")) & _safe_part(x)),
                                      F.filter(p, _safe_part))
                    return let(F.coalesce(known, fresh), lambda label: F.struct(
                        _add(state["phrases"], many, label).alias("phrases"),
                        _add(state["words"], single, label).alias("words")))

                return let(variants, assign)

            return let(parts, of_parts)

        return let(F.array_join(words(person["name"]), " "), of_name)

    none = F.array().cast(_PAIRS)
    return F.aggregate(found, F.struct(none.alias("phrases"), none.alias("words")) if known is None else known, step)


def _longest_first(pairs: Column) -> Column:
    return F.array_sort(pairs, lambda a, b: F.length(b["k"]) - F.length(a["k"]))


def replace_words(text: Column, pairs: Column, flags: str = "") -> Column:
    """Whole-word replacement of every key, longest first."""
    def step(current: Column, pair: Column) -> Column:
        pattern = F.concat(F.lit(flags + vocab.NOT_AFTER_WORD), quoted(pair["k"]), F.lit(vocab.NOT_BEFORE_WORD))
        return F.call_function("regexp_replace", current, pattern, pair["v"])
    return F.aggregate(_longest_first(pairs), text, step)


def mask_people(text: Column, found: Column) -> Column:
    """Names of ``found`` people: phrases whatever their case, single parts only as written."""
    return let(aliases(found), lambda a: replace_words(replace_words(text, a["phrases"], "(?iu)"), a["words"]))


# ---- labelled values ---------------------------------------------------------------------
_LABELLED = [(vocab.IDENTIFIER_LABEL, "[IDENTIFIER]"), (vocab.DOB_LABEL, "[DOB]"), (vocab.PHONE_LABEL, "[PHONE]"),
             (vocab.LOCATION_LABEL, "[LOCATION]")]


def labelled_values(context: Column) -> Column:
    """Values found after a label anywhere in the package; a later rule wins a shared value."""
    return _labelled_pairs([matches(context, pattern, 1) for pattern, _ in _LABELLED])


def _labelled_pairs(values: list[Column]) -> Column:
    """Pairs of the values of each rule, in the order of the rules."""
    def pairs(own: Column, label: str) -> Column:
        return F.transform(own, lambda v: F.struct(v.alias("k"), F.lit(label).alias("v")))

    found = F.concat(*[pairs(own, label) for own, (_, label) in reversed(list(zip(values, _LABELLED)))]).cast(_PAIRS)
    return F.aggregate(found, F.array().cast(_PAIRS), lambda kept, p: F.when(
        F.exists(kept, lambda q: q["k"] == p["k"]), kept).otherwise(F.concat(kept, F.array(p))).cast(_PAIRS))


def mask_labelled(text: Column, values: Column) -> Column:
    """Labelled passages masked, then every value found after a label masked wherever it occurs."""
    for pattern, label in _LABELLED:
        if pattern == vocab.PHONE_LABEL:
            # Only the number goes; the label stays readable.
            text = F.regexp_replace(text, vocab.PHONE_LABEL_KEPT, "$1" + label)
        else:
            text = F.regexp_replace(text, pattern, label)
    return replace_words(text, values)


def package_names(context: Column) -> Column:
    """{aliases, labelled}: what a package's context tells its fields, to be made once for all of them."""
    return F.struct(aliases(people(context)).alias("aliases"), F.array(*[matches(context, pattern, 1) for pattern, _ in _LABELLED]).alias("labelled"))


def sanitize_field(text: Column, names: Column) -> Column:
    """All deterministic rules on a field that is a line or more of the context behind ``names``: it adds none itself."""
    values = _labelled_pairs([F.get(names["labelled"], F.lit(i)) for i in range(len(_LABELLED))])
    hidden = replace_words(replace_words(mask_contacts(text), names["aliases"]["phrases"], "(?iu)"), names["aliases"]["words"])
    return mask_labelled(hidden, values)


def sanitize(text: Column, names: Column) -> Column:
    """All deterministic rules on one text; names and values come from its package and from the text itself.

    No rule that finds them matches across a line break, so the context and the text are searched one by one.
    """
    def run(t: Column) -> Column:
        values = _labelled_pairs([F.concat(F.get(names["labelled"], F.lit(i)), matches(t, p, 1)) for i, (p, _) in enumerate(_LABELLED)])
        hidden = let(aliases(people(t), names["aliases"]), lambda a: replace_words(replace_words(mask_contacts(t), a["phrases"], "(?iu)"), a["words"]))
        return mask_labelled(hidden, values)

    return let(text, run)


# ---- invariants --------------------------------------------------------------------------
def negations(text: Column) -> Column:
    return matches(text, vocab.NEGATION)


def plain_numbers(text: Column) -> Column:
    return matches(text, vocab.PLAIN_NUMBER)


def protected_values(text: Column) -> Column:
    """Quantities with units and clinical dates that redaction must leave unchanged."""
    unlabelled = F.regexp_replace(F.regexp_replace(text, vocab.IDENTIFIER_LABEL, "[IDENTIFIER]"), vocab.DOB_LABEL, "[DOB]")
    generic = F.regexp_replace(text, vocab.LOCATION_LABEL, "[LOCATION]")
    return F.struct(F.concat(matches(text, vocab.CLINICAL_NUMBER), matches(generic, vocab.GENERIC_QUANTITY)).alias("quantities"),
                    matches(unlabelled, vocab.CLINICAL_DATE).alias("dates"))


def numeric_identifiers(context: Column) -> Column:
    """Labelled values made of digits and signs only."""
    found = F.concat(*[matches(context, p, 1) for p in (vocab.IDENTIFIER_LABEL, vocab.DOB_LABEL, vocab.PHONE_LABEL)])
    return F.array_distinct(F.filter(found, lambda v: v.rlike(r"\d") & ~v.rlike("[A-Za-zА-Яа-яЁё]")))


def identifier_collision(field: Column, values: Column) -> Column:
    """A labelled numeric id occurs again inside other words of the field: the package is ambiguous."""
    rest = field
    for pattern in (vocab.IDENTIFIER_LABEL, vocab.DOB_LABEL, vocab.PHONE_LABEL):
        rest = F.regexp_replace(rest, pattern, "[IDENTIFIER]")

    def check(remaining: Column) -> Column:
        alone = F.regexp_replace(strip(remaining), r"^(?:Archive evidence:|По источникам архива:)\s*", "")
        alone = strip(F.regexp_replace(alone, r"\s*\[S\d+\]\s*\z", ""))
        return F.exists(values, lambda v: (alone != v) & F.contains(remaining, v) & F.call_function(
            "rlike", remaining, F.concat(F.lit(vocab.NOT_AFTER_WORD), quoted(v), F.lit(vocab.NOT_BEFORE_WORD))))

    return let(rest, check)


def is_placeholder(span: Column) -> Column:
    return span.rlike(vocab.PLACEHOLDER)
