"""Keyed surrogates for personal data, in DataFrame and SQL functions only.

One pattern finds the entities of a text.  Each entity has a canonical form
(digits of a number, lower-case letters of an address, ...); a keyed hash of
type and canonical form makes the surrogate, so equal entities get equal
surrogates in every document.  Over the table of distinct entities Spark checks
that no two share a surrogate and that none equals a real entity; the few that
do are keyed anew until all differ, and given names get the gender that most of
their titles have.  Only these exceptions are looked up when the texts are
rewritten.  Names that a text has after a title are then replaced wherever the
text has them without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Documents with exceptions; a table of so many is broadcast, of more is joined by a shuffle.
BROADCAST_LIMIT = 100_000
#: So many attempts keep the size of a number; later ones add digits to it.
SAME_SIZE = 8

# Titles by gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Signora", "Lady", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Mx", "Доктор")

_TITLE = "(?:" + "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True)) + ")"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+(?<=\.\p{L}{2,24})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z]{0,4}\d{10,26}(?![\p{L}\p{N}])"
_SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+\d)(?=[\d_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/-])"
_NAMED = r"(?<=(?:password|passwd|secret|token|api_key|apikey)[\"']?\s?[:=]\s?[\"'])[^\s\"']{6,}+(?=[\"'])"
_WORD = r"\p{Lu}[\p{Ll}'’-]+(?:(?<=['’-])\p{Lu}[\p{Ll}'’-]+)*"
_PERSON = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? {_WORD}(?: (?:\p{{Lu}}\. )?{_WORD}){{0,2}}"
ENTITY = "|".join((_EMAIL, _PERSON, _IP, _PHONE, _SSN, _IBAN, _NAMED, _CARD, _SECRET))
#: A quick look: texts without any of this hold no entity.
MAYBE = rf"[@0-9]|(?:password|passwd|secret|token|api_key|apikey)|{_TITLE}\.? \p{{Lu}}"


def _sql(text: str) -> str:
    """A pattern or word as a SQL literal."""
    return "r'" + text.replace("'", "\\x27") + "'" if "\\" in text or "'" in text else f"'{text}'"


def _rlike(value: str, pattern: str) -> str:
    return f"{value} rlike {_sql(pattern)}"


def _kind(m: str) -> str:
    """SQL: the type of a match that is no person."""
    return f"""case when {_rlike(m, r"^[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]++$")} then 'email'
        when {_rlike(m, rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")} then 'ip'
        when {_rlike(m, r"^\d{3}-\d{2}-\d{4}$")} then 'ssn'
        when {_rlike(m, r"^[+(][\d (]|^\d{3}[-.]\d{3}[-.]\d{4}$")} then 'phone'
        when {_rlike(m, r"^\d[\d -]{11,21}\d$")} then 'card'
        when {_rlike(m, r"^[A-Z]{2}\d{2}(?: [A-Z0-9]{1,4}){3,8}$|^[A-Z]{2}\d{2}[A-Z]{0,4}\d{10,26}$")} then 'iban'
        else 'secret' end"""


def _canonical(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"""case {kind} when 'email' then lower({m})
        when 'phone' then right({digits}, 10)
        when 'card' then {digits} when 'ssn' then {digits}
        when 'iban' then replace({m}, ' ', '')
        else {m} end"""


def _is_person(m: str) -> str:
    return _rlike(m, rf"^{_TITLE}\.? \p{{Lu}}")


def _gender(m: str) -> str:
    """SQL: 'f', 'm' or '' (the title says nothing)."""
    return f"case when {_rlike(m, '^(?:' + '|'.join(sorted(FEMALE, key=len, reverse=True)) + r')\.? ')} then 'f' when {_rlike(m, '^(?:' + '|'.join(sorted(MALE, key=len, reverse=True)) + r')\.? ')} then 'm' else '' end"


def _names(m: str) -> str:
    """SQL: ``(kind, canonical, gender, word)`` of the names in a person match:
    the last is a surname, those before it are given names, initials none."""
    parts = f"filter(split(regexp_replace({m}, {_sql('^' + _TITLE + r'\.? ')}, ''), ' '), w -> w not like '%.')"
    return f"""transform(element_at(transform(array({parts}), p -> transform(p, (w, i) -> named_struct('w', w, 'given', i < size(p) - 1))), 1), x -> named_struct(
        'kind', if(x.given, 'given', 'surname'), 'canonical', lower(x.w), 'gender', if(x.given, {_gender(m)}, ''), 'word', x.w))"""


def _entities(m: str) -> str:
    """SQL: all ``(kind, canonical, gender, word)`` of a match."""
    kind = _kind(m)
    return f"case when {_is_person(m)} then {_names(m)} else array(named_struct('kind', {kind}, 'canonical', {_canonical('(' + kind + ')', m)}, 'gender', '', 'word', '')) end"


def _hash(key: str, kind: str, canonical: str, attempt: str) -> str:
    return f"sha2(concat_ws('|', {_sql(key)}, {attempt}, {kind}, {canonical}), 256)"


def _digits(h: str) -> str:
    """64 decimal digits of a hash."""
    return f"translate(sha2({h}, 256), 'abcdef', '258147')"


def _masked(s: str, h: str, attempt: str = "0") -> str:
    """SQL: ``s`` with each letter and digit replaced by one of its kind, or all
    of it by letters if it has neither; two letters longer with each attempt."""
    at = "pmod(i, 64) + 1"
    letters, hexes = "translate(b.h, '0123456789abcdef', 'bcdfghjkmnprstvz')", "translate(b.h, '0123456789', 'abcdefbdfa')"
    # let-bindings, as in _replaced: the hash and the looks at the whole of a long secret are made once, not for each character
    whole = f"named_struct('s', b.s, 'd', {_digits('b.h')}, 'l', {letters}, 'x', {hexes}, 'low', {_rlike('b.s', '^[0-9a-f]+$')}, 'up', {_rlike('b.s', '^[0-9A-F]+$')}, 'bare', not {_rlike('b.s', r"[\p{L}\p{N}]")})"
    each = f"""transform(split(b.s, ''), (c, i) ->
        case when c between '0' and '9' then substr(b.d, {at}, 1)
             when b.low then substr(b.x, {at}, 1)
             when b.up then upper(substr(b.x, {at}, 1))
             when {_rlike("c", r"^\p{Lu}$")} then upper(substr(b.l, {at}, 1))
             when {_rlike("c", r"^\p{L}$")} or b.bare then substr(b.l, {at}, 1)
             when {_rlike("c", r"^\p{N}$")} then substr(b.d, {at}, 1)
             else c end)"""
    more = "" if attempt == "0" else f", right(case when b.low then b.x when b.up then upper(b.x) else b.l end, 2 * cast({attempt} as int))"
    return f"element_at(transform(transform(array(named_struct('s', {s}, 'h', {h})), b -> {whole}), b -> concat(array_join({each}, ''){more})), 1)"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits."""
    return f"""aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int)
        else cast(c as int) * 2 - if(c > '4', 9, 0) end), 0, (a, x) -> a + x)"""


def _card(canonical: str, h: str) -> str:
    """SQL: as many digits, and a valid check digit if the real one is valid."""
    body = f"concat(substr({canonical}, 1, 1), substr({_digits(h)}, 1, length({canonical}) - 2))"
    return f"""concat({body}, case when {_luhn(canonical)} % 10 = 0 then cast(pmod(10 - {_luhn(f"concat({body}, '0')")} % 10, 10) as string) else substr({_digits(h)}, 64, 1) end)"""


def _name(kind: str, canonical: str, gender: str, h: str, attempt: str) -> str:
    """SQL: a name in the script of the real one, its ending by gender; one
    syllable longer with each attempt."""

    def spelled(consonants: str, vowels: str, ends: tuple[str, str, str, str]) -> str:
        c, v = f"translate({h}, '0123456789abcdef', '{consonants}')", f"translate({h}, '0123456789abcdef', '{vowels}')"
        syllables = f"array_join(transform(sequence(1, 3 + {attempt}), i -> concat(substr({c}, 2 * i, 1), substr({v}, 2 * i + 21, 1))), '')"
        female, male, given, surname = ends
        return f"concat({syllables}, case when {kind} = 'surname' then '{surname}' when {gender} = 'f' then '{female}' when {gender} = 'm' then '{male}' else '{given}' end)"

    return f"""initcap(case when {_rlike(canonical, r"\p{IsCyrillic}")} then {spelled("бвгджзклмнпрстфх", "аеиоуаеиоуаеиоуа", ("на", "н", "й", "ов"))}
        when {_rlike(canonical, r"\p{IsGreek}")} then {spelled("βγδζθκλμνξπρστφχ", "αειουαειουαειουα", ("να", "ς", "ν", "δης"))}
        else {spelled("bdfghjklmnprstvz", "aeiouaeiouaeioua", ("na", "n", "l", "r"))} end)"""


def _fake(key: str, kind: str, canonical: str, gender: str, attempt: str = "0") -> str:
    """SQL: the canonical form of the surrogate.  Later attempts have more forms
    to choose from: addresses, secrets and names grow from the first one on,
    numbers by a digit with each attempt after ``SAME_SIZE``."""
    h = _hash(key, kind, canonical, attempt)
    domain = f"substring_index({canonical}, '@', -1)"
    octets = ", '.', ".join(f"cast(1 + conv(substr({h}, {2 * i + 1}, 2), 16, 10) % 254 as string)" for i in range(4))

    def longer(number: str, mark: str = "") -> str:
        if attempt == "0":
            return number
        return f"concat({number}, if({attempt} > {SAME_SIZE}, concat('{mark}', right({_digits(h)}, cast({attempt} as int) - {SAME_SIZE})), ''))"

    return f"""case when {kind} = 'email' then concat({_masked(f"substring_index({canonical}, '@', 1)", h, attempt)}, '@mail', substr({_digits(_hash(key, "'domain'", domain, "'0'"))}, 1, 9), '.example.net')
        when {kind} = 'ip' then {longer(f"concat({octets})", ".")}
        when {kind} in ('phone', 'ssn') then {longer(f"substr({_digits(h)}, 1, length({canonical}))")}
        when {kind} = 'card' then {longer(_card(canonical, h))}
        when {kind} = 'iban' then {longer(f"concat(substr({canonical}, 1, 2), {_masked(f'substr({canonical}, 3)', h)})")}
        when {kind} in ('given', 'surname') then lower({_name(kind, canonical, gender, h, f"cast({attempt} as int)")})
        else {_masked(canonical, h, attempt)} end"""


def _fitted(kind: str, m: str, fake: str) -> str:
    """SQL: the surrogate in the format of the occurrence ``m``."""
    # numbers: the last digits are the surrogate's, what stands before or between them stays;
    # digits of a surrogate that had to grow come after all
    n = f"length(regexp_replace({m}, '[^0-9]', ''))"
    own = f"if({kind} = 'phone', least(10, {n}), {n})"
    filled = f"""aggregate(split({m}, ''), named_struct('out', '', 'k', 1 + {own} - {n}),
        (a, c) -> case when c between '0' and '9' then named_struct('out', concat(a.out, if(a.k > 0, substr({fake}, a.k, 1), c)), 'k', a.k + 1)
                  else named_struct('out', concat(a.out, c), 'k', a.k) end, a -> concat(a.out, substr({fake}, 1 + {own})))"""
    spaced = f"""aggregate(split({m}, ''), named_struct('out', '', 'k', 1),
        (a, c) -> case when c = ' ' then named_struct('out', concat(a.out, ' '), 'k', a.k)
                  else named_struct('out', concat(a.out, substr({fake}, a.k, 1)), 'k', a.k + 1) end, a -> concat(a.out, substr({fake}, a.k)))"""
    cased = f"""array_join(transform(split({fake}, ''), (c, i) -> if({_rlike(f"substr({m}, i + 1, 1)", r"^\p{Lu}$")}, upper(c), c)), '')"""
    return f"""case when {kind} in ('phone', 'card', 'ssn') then {filled} when {kind} = 'iban' then {spaced}
        when {kind} = 'email' then concat(substring_index({cased}, '@', 1), '@', substring_index({fake}, '@', -1)) else {fake} end"""


def _of(key: str, kind: str, canonical: str, gender: str, exceptions: str | None) -> str:
    fake = _fake(key, kind, canonical, gender)
    return fake if exceptions is None else f"coalesce(try_element_at({exceptions}, concat({kind}, '|', {canonical})), {fake})"


def _replaced(key: str, m: str, exceptions: str | None) -> str:
    kind = f"({_kind(m)})"
    # let-bindings: one-element arrays keep each part evaluated once
    plain = f"""element_at(transform(transform(array(named_struct('kind', {kind}, 'canonical', {_canonical(kind, m)})), e -> named_struct('kind', e.kind, 'fake', {_of(key, 'e.kind', 'e.canonical', "''", exceptions)})),
        e -> {_fitted('e.kind', m, 'e.fake')}), 1)"""
    # a person's names go with those that stand without a title
    return f"case when {_is_person(m)} then {m} else {plain} end"


def _renamed(key: str, text: str, exceptions: str | None) -> str:
    """SQL: ``text`` with the names of the person matches replaced wherever they
    stand as words of their own, written as after the title."""
    names = f"array_distinct(flatten(transform(filter(_m, m -> {_is_person('m')}), m -> {_names('m')})))"
    # longer words first: a name may be a part of another (Anna, Anna-Lena)
    listed = f"array_sort({names}, (x, y) -> case when length(x.word) > length(y.word) then -1 when length(x.word) < length(y.word) then 1 when x.kind < y.kind then -1 when x.kind > y.kind then 1 else 0 end)"
    alone = "concat('(?<![\\\\p{L}\\\\p{N}])\\\\Q', n.word, '\\\\E(?![\\\\p{L}\\\\p{N}])')"
    return f"aggregate({listed}, {text}, (t, n) -> regexp_replace(t, {alone}, initcap({_of(key, 'n.kind', 'n.canonical', 'n.gender', exceptions)})))"


def _matches(text: str) -> Column:
    return F.when(F.col(text).rlike(MAYBE), F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, gender, fake, attempt`` of distinct ``kind, canonical``:
    all ``fake`` of a kind differ, and none is a canonical form of that kind; a
    name's surrogate is no name, given or surname, and of one kind only.

    ``gender`` may be missing.  Ends for any entities: each attempt has some ten
    times the surrogates of the one before it, from the first on or after
    ``SAME_SIZE``.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(""))
    # given names and surnames share one space, as words of a text they look alike
    space = F.when(F.col("kind").isin("given", "surname"), "name").otherwise(F.col("kind"))
    entities = cut(entities.select("kind", "canonical", "gender").withColumn("space", space))
    settled = cut(entities.withColumn("attempt", F.lit(0)).withColumn("fake", F.expr(_fake(key, "kind", "canonical", "gender", "attempt"))))
    attempt = 0
    while True:
        shared = settled.groupBy("space", "fake").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = shared.select("space", "fake", F.col("first.kind").alias("_kind"), F.col("first.canonical").alias("_first"))
        later = settled.join(shared, ["space", "fake"]).where("canonical != _first or kind != _kind").select("kind", "canonical")
        real = settled.join(entities.select("space", F.col("canonical").alias("fake")).distinct(), ["space", "fake"], "left_semi").select("kind", "canonical")
        again = cut(later.union(real).distinct())
        if again.isEmpty():
            return settled.drop("space")
        attempt += 1
        anew = settled.join(again, ["kind", "canonical"], "left_semi").withColumn("attempt", F.lit(attempt)).withColumn("fake", F.expr(_fake(key, "kind", "canonical", "gender", "attempt")))
        settled = cut(settled.join(again, ["kind", "canonical"], "left_anti").unionByName(anew))


def replace(docs: DataFrame, *, secret: str = "strataflow", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``_n_entities``
    and ``_kinds`` (sorted distinct types) added.

    Types: email, phone, card, ip, ssn, iban, secret, and names after a title,
    given and surname.  Phones keep country code and punctuation, cards their
    first digit and validity, secrets and addresses their kinds of characters,
    names their script and gender: a given name has the gender that most
    documents' titles before it say (of equal ones the female; none if no title
    tells), whatever title it stands after.  In a text with a name after a title
    the name is replaced wherever it is a word, written alike; in other texts an
    untitled name stays.  Mail goes to domains under example.net.

    All columns of ``docs`` are kept, but for columns named ``_n_entities`` or
    ``_kinds``, which the new ones replace; no other name clashes.  A null text
    stays null and holds no entity; texts without entities stay as they are;
    repeated rows each come back alike; an empty table gives an empty result.  A
    secret or address of any length is one entity.  ``docs`` is read twice.
    """
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_t"), F.col(key).alias("_k"))
    body = body.withColumn("_m", _matches("_t"))
    mark = F.xxhash64("_t")
    # a row for each distinct entity of a text
    own = body.select("_k", mark.alias("_h"), F.explode(F.expr(f"array_distinct(flatten(transform(_m, m -> {_entities('m')})))")).alias("e"))
    own = cut(own.select("_k", "_h", "e.kind", "e.canonical", "e.gender").distinct())
    tell = lambda g: F.count(F.when(F.col("gender") == g, True))
    found = own.groupBy("kind", "canonical").agg(tell("f").alias("f"), tell("m").alias("m"), tell("").alias("none"))
    gender = F.when(F.col("f") + F.col("m") == 0, "").when(F.col("f") >= F.col("m"), "f").otherwise("m")
    mixed = (F.col("f") > 0).cast("int") + (F.col("m") > 0).cast("int") + (F.col("none") > 0).cast("int") > 1
    found = cut(found.select("kind", "canonical", gender.alias("gender"), mixed.alias("mixed")))
    odd = surrogates(found, secret).join(found.select("kind", "canonical", "mixed"), ["kind", "canonical"]).where("attempt > 0 or mixed")
    looked_up = cut(
        own.join(odd.select("kind", "canonical", "fake"), ["kind", "canonical"])
        .select("_k", "_h", F.concat_ws("|", "kind", "canonical").alias("name"), "fake")
        .distinct()
        .groupBy("_k", "_h")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "fake"))).alias("_x"))
    )
    n = looked_up.count()
    exceptions = "_x" if n else None
    if n:
        looked_up = looked_up.withColumnsRenamed({"_k": "_k2", "_h": "_h2"})
        if n <= BROADCAST_LIMIT:
            looked_up = F.broadcast(looked_up)
        body = body.join(looked_up, F.col("_k").eqNullSafe(F.col("_k2")) & (mark == F.col("_h2")), "left")
    filled = f"array_join(zip_with(split(_t, {_sql(ENTITY)}, -1), array_append(transform(_m, m -> {_replaced(secret, 'm', exceptions)}), ''), (a, b) -> concat(a, b)), '')"
    out = body.withColumn("_new", F.when(F.size("_m") > 0, F.expr(filled)).otherwise(F.col("_t")))
    person = f"exists(_m, m -> {_is_person('m')})"
    out = out.withColumn("_new", F.expr(f"if({person}, {_renamed(secret, '_new', exceptions)}, _new)"))
    kinds = F.expr(f"sort_array(array_distinct(transform(flatten(transform(_m, m -> {_entities('m')})), e -> e.kind)))")
    kept = [(F.col("_new") if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns if c not in ("_n_entities", "_kinds")]
    return out.select(*kept, F.size("_m").alias("_n_entities"), kinds.alias("_kinds"))
