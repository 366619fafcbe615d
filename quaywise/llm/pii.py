"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.
DataFrame functions only."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind -> pattern, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:.])",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])",
    "phone": r"(?<![\d-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\d-]|\.\d)|(?:\+\d{1,3}[ -]?)?\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|\+\d(?:[ ()-]{0,2}\d){7,14}(?!\d)",
}
#: Prefixes of international numbers, as assigned or reserved for regions; 999 isn't.
CALLING_CODES = r"^(?:1|7|2[07]|2[1-689]\d|3[0-469]|3[578]\d|4[013-9]|42\d|5[1-8]|5[09]\d|6[0-6]|6[789]\d|8[1246]|8[035789]\d|9[0-58]|9[67]\d|99[2-68])"
ROUNDS = 10
#: Steps of a walk through a permutation until it is back among dates of one kind; each misses with at most six in ten.
WALK = 160
#: Where the key of pseudonyms is looked up.
KEY_SETTING = "quaywise.pseudonyms.secret"  # Spark redacts settings of such names in its logs and pages
#: The column that holds the key while texts are read: a subquery's value, so that plans and logs don't show it.
KEY = "_q_k"
#: Days of 1900-01-01 to 2099-12-31, a product of the radices of the two halves.
DATE_RADICES = (17, 4297)


def _q(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, left: str, right: str, tweak: str, inverse: bool = False) -> str:
    """SQL: a keyed permutation of the integers 0 to left * right - 1, applied to the SQL ``value``.

    The value is split into two digits of radix ``left`` and ``right``; each round adds to one, modulo its radix, a
    digest of the other, the key, the tweak (the kind and format) and the round, so it can be undone.
    """
    sign = "-" if inverse else "+"
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"

    def f(half: str) -> str:
        digest = f"sha2(concat_ws('|', {KEY}, {tweak}, i, {half}), 256)"
        return f"cast(conv(substring({digest}, 1, 15), 16, 10) as bigint)"

    return f"""aggregate({rounds}, named_struct('l', cast(({value}) div ({right}) as bigint), 'r', cast(({value}) % ({right}) as bigint)),
        (a, i) -> named_struct('l', CASE WHEN i % 2 = 0 THEN pmod(a.l {sign} pmod({f("a.r")}, {left}), {left}) ELSE a.l END,
                               'r', CASE WHEN i % 2 = 1 THEN pmod(a.r {sign} pmod({f("a.l")}, {right}), {right}) ELSE a.r END),
        a -> a.l * ({right}) + a.r)"""


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, r'[^0-9]', '')"


def _fill(form: str, digits: str) -> str:
    """SQL: ``form`` with its digits replaced in turn by those of ``digits``."""
    nth = _digits(f"substring({form}, 1, j)")
    one = f"substring({form}, j, 1)"
    return f"array_join(transform(sequence(1, length({form})), j -> CASE WHEN {one} RLIKE r'[0-9]' THEN substring({digits}, length({nth}), 1) ELSE {one} END), '')"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, the last digit counting once."""
    d = f"cast(substring({digits}, length({digits}) - k, 1) as int)"
    twice = f"CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, k) -> t + CASE WHEN k % 2 = 1 THEN {twice} ELSE {d} END)"


def _numeric(digits: str, tweak: str, inverse: bool) -> str:
    """SQL: a permutation of the digit strings of one length (2 to 18)."""
    right = f"cast(power(10, length({digits}) - length({digits}) div 2) as bigint)"
    left = f"cast(power(10, length({digits}) div 2) as bigint)"
    return f"lpad(cast({feistel(f'cast({digits} as bigint)', left, right, f'concat({_sql(tweak)}, length({digits}))', inverse)} as string), length({digits}), '0')"


def _card(m: str, inverse: bool) -> str:
    """The first digit (the network) stays, the middle is permuted and the check digit computed anew."""
    new = f"concat(substring(d, 1, 1), {_numeric('substring(d, 2, length(d) - 2)', 'card', inverse)})"
    check = f"concat(n, cast(pmod(-({_luhn('concat(n, 0)')}), 10) as string))"
    valid = f"CASE WHEN {_luhn('d')} % 10 = 0 THEN {_let('n', new, _let('c', check, _fill(m, 'c')))} ELSE {m} END"
    return _let("d", _digits(m), valid)


def _ipv4(m: str, inverse: bool) -> str:
    octets = f"transform(split({m}, r'\\.'), o -> cast(o as bigint))"
    value = "aggregate(p, 0L, (t, o) -> t * 256 + o)"
    out = "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)"
    return _let("p", octets, f"CASE WHEN exists(p, o -> o > 255) THEN {m} ELSE {_let('n', feistel(value, '65536', '65536', _sql('ipv4'), inverse), out)} END")


def _ssn(m: str, inverse: bool) -> str:
    """Valid areas are 001 to 899 but 666; groups 01 to 99; serials 0001 to 9999."""
    part = [f"cast(split({m}, '-')[{i}] as bigint)" for i in range(3)]
    valid = f"{part[0]} BETWEEN 1 AND 899 AND {part[0]} <> 666 AND {part[1]} > 0 AND {part[2]} > 0"
    area = f"({part[0]} - CASE WHEN {part[0]} > 666 THEN 2 ELSE 1 END)"
    value = f"({area} * 99 + {part[1]} - 1) * 9999 + {part[2]} - 1"
    a, g, s = "n div 989901", "n div 9999 % 99 + 1", "n % 9999 + 1"
    back = f"({a} + CASE WHEN {a} >= 665 THEN 2 ELSE 1 END)"
    out = f"concat_ws('-', lpad(cast({back} as string), 3, '0'), lpad(cast({g} as string), 2, '0'), lpad(cast({s} as string), 4, '0'))"
    return f"CASE WHEN {valid} THEN {_let('n', feistel(value, '88902', '9999', _sql('ssn'), inverse), out)} ELSE {m} END"


def _date(m: str, inverse: bool) -> str:
    """Dates of 1900 to 2099 in five formats; equal dates stay equal over formats. 01/02/2020 is read month first, and day first
    where only that is a date (25/12/1980).

    Days of month over 12 stay over 12, and the others below: the permutation is walked until that holds, which is itself a
    permutation, so a day-first date is printed as one and is read back.
    """
    forms = [r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}/\d{2}/\d{4}", r"\d{2}/\d{2}/\d{4}"]
    styles = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]
    tests = [f"{m} RLIKE {_q('^' + f + '$')} AND try_to_date({m}, '{s}') IS NOT NULL" for f, s in zip(forms, styles, strict=True)]
    day = " ".join(f"WHEN {t} THEN try_to_date({m}, '{s}')" for t, s in zip(tests, styles, strict=True))

    def late(x: str) -> str:
        return f"(day(date_add(date'1900-01-01', cast({x} as int))) > 12)"

    once = feistel("w", *map(str, DATE_RADICES), _sql("date"), inverse)
    first = feistel("datediff(v, date'1900-01-01')", *map(str, DATE_RADICES), _sql("date"), inverse)
    walked = f"aggregate(sequence(1, {WALK}), cast({first} as bigint), (w, _s) -> CASE WHEN {late('w')} = (day(v) > 12) THEN w ELSE cast({once} as bigint) END)"
    new = f"date_add(date'1900-01-01', cast({walked} as int))"
    back = " ".join(f"WHEN {t} THEN date_format(n, '{s}')" for t, s in zip(tests, styles, strict=True))
    out = f"CASE WHEN v BETWEEN date'1900-01-01' AND date'2099-12-31' THEN {_let('n', new, f'CASE {back} END')} ELSE {m} END"
    return _let("v", f"CASE {day} END", out)


def _phone(m: str, inverse: bool) -> str:
    """An international number keeps its calling code, which must be one; others are permuted as a whole."""
    code = f"CASE WHEN {m} LIKE '+%' THEN length(regexp_extract(d, {_q(CALLING_CODES)}, 0)) ELSE 0 END"
    valid = f"({m} NOT LIKE '+%' OR k > 0) AND length(d) <= 15"
    new = f"concat(substring(d, 1, k), {_numeric('substring(d, k + 1)', 'phone', inverse)})"
    return _let("d", _digits(m), _let("k", code, f"CASE WHEN {valid} THEN {_let('n', new, _fill(m, 'n'))} ELSE {m} END"))


def _chunks(text: str, size: int, one: str) -> str:
    """SQL: ``text`` in chunks ``c`` of up to ``size`` characters, chunk number ``part``, each replaced by ``one`` and joined again."""
    return f"array_join(transform(sequence(1, greatest(1, length({text})), {size}), (p, part) -> {_let('c', f'substring({text}, p, {size})', one)}), '')"


def _mod97(text: str) -> str:
    """SQL: a text of digits and capitals as a number, a letter counting as 10 to 35, modulo 97."""
    value = "CASE WHEN x RLIKE '[0-9]' THEN cast(x as int) ELSE ascii(x) - 55 END"
    return f"aggregate(split({text}, ''), 0, (t, x) -> CASE WHEN x = '' THEN t WHEN x RLIKE '[0-9]' THEN (t * 10 + {value}) % 97 ELSE (t * 100 + {value}) % 97 END)"


def _iban(m: str, inverse: bool) -> str:
    """Country and letters stay, the account's digits are permuted, up to fifteen at a time, and the check digits computed anew."""
    account = "substring(b, 5)"
    digit = _digits(account)
    permuted = _chunks("g", 15, f"CASE WHEN length(c) < 2 THEN c ELSE {_numeric('c', 'iban', inverse)} END")
    filled = _let("g", digit, _let("q", permuted, _fill(account, "q")))
    check = f"lpad(cast(98 - {_mod97('concat(a, substring(b, 1, 2), 0, 0)')} as string), 2, '0')"
    built = _let("a", filled, f"concat(substring(b, 1, 2), {check}, a)")
    spaced = _let("z", built, f"CASE WHEN {m} LIKE '% %' THEN trim(regexp_replace(z, r'(.{{4}})', '$1 ')) ELSE z END")
    valid = f"{_mod97('concat(substring(b, 5), substring(b, 1, 4))')} = 1 AND substring(b, 3, 2) BETWEEN '02' AND '98'"
    return _let("b", f"replace({m}, ' ', '')", f"CASE WHEN {valid} THEN {spaced} ELSE {m} END")


def _ipv6(m: str, inverse: bool) -> str:
    """The 128 bits are permuted, twelve hexadecimal digits at a time, and printed as eight groups: one address has one pseudonym, however it is written.

    With '::' it must say more than two words with colons between: two groups or more and a digit before them, or a first group that
    addresses are given out under (2000 to 3fff, fc00 to fdff, fe80 to febf), or ::ffff, for those of version 4.
    """
    left, right = ("cast(power(16, {}) as bigint)".format(x) for x in ("length(c) div 2", "length(c) - length(c) div 2"))
    value = "cast(conv(c, 16, 10) as bigint)"
    new = f"lpad(lower(conv(cast({feistel(value, left, right, f'concat({_sql('ipv6')}, part, length(c))', inverse)} as string), 10, 16)), length(c), '0')"
    groups = "filter(split({}, ':'), y -> y <> '')"
    ahead, behind = groups.format("split(h, '::')[0]"), groups.format("split(h, '::')[1]")
    whole = f"CASE WHEN h LIKE '%::%' THEN concat({ahead}, array_repeat('0', 8 - size({ahead}) - size({behind})), {behind}) ELSE split(h, ':') END"
    given = "regexp_like(h, '^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|::ffff):')"
    valid = f"(h NOT LIKE '%::%' OR (size({ahead}) + size({behind}) <= 7 AND ({given} OR (size({ahead}) >= 2 AND h RLIKE '[0-9]'))))"
    digits = f"array_join(transform({whole}, y -> lpad(y, 4, '0')), '')"
    printed = "array_join(transform(sequence(1, 29, 4), x -> regexp_replace(substring(q, x, 4), '^0{1,3}', '')), ':')"
    return _let("h", f"lower({m})", f"CASE WHEN {valid} THEN {_let('g', digits, _let('q', _chunks('g', 12, new), printed))} ELSE {m} END")


def _email(m: str) -> str:
    """Addresses have no number format: a keyed alias, equal for equal addresses, in a domain that can't exist."""
    return f"concat('u', substring(sha2(concat_ws('|', {KEY}, 'email', lower({m})), 256), 1, 16), '@redacted.invalid')"


def pseudonym(match: str, inverse: bool = False) -> str:
    """SQL: what replaces one match; a match that no validation accepts stays."""
    email = match if inverse else _email(match)
    by = {"email": email, "iban": _iban(match, inverse), "ipv6": _ipv6(match, inverse), "ipv4": _ipv4(match, inverse), "date": _date(match, inverse), "ssn": _ssn(match, inverse), "card": _card(match, inverse), "phone": _phone(match, inverse)}
    return "CASE " + " ".join(f"WHEN {match} RLIKE {_q('^(?:' + PATTERNS[k] + ')$')} THEN {v}" for k, v in by.items()) + f" ELSE {match} END"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """Replace validated personal data in ``text`` and add ``n_private``, the number of values replaced.

    Cards (Luhn), IBANs (check digits), social security numbers, IPv4 and IPv6 addresses, dates and phone numbers are permuted
    within their format by a key, so equal values stay equal over all documents, valid values stay valid and ``inverse``
    undoes it; e-mail addresses become keyed aliases. Values that fail validation stay as they are. Null and empty texts stay; a very
    long text is cut at its values once; repeated rows each get a row, with equal values; an empty table gives an empty
    result; all columns are kept, ``n_private`` being replaced; ``_q_k``, ``_q_m`` and ``_q_r`` are reserved names. IPv6 addresses come back
    from ``inverse`` as eight groups. Lower-case IBANs, phone numbers without any separator, and dates with names of months aren't read. Texts without a digit, an at
    sign or two colons are passed by. Where two values could begin at one place the kind named first in PATTERNS is taken.
    """
    import re

    if clash := {KEY, "_q_m", "_q_r"} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are reserved names")

    parts, shift = [], 0
    for p in PATTERNS.values():  # groups are numbered over the whole alternation
        parts.append(re.sub(r"\\([1-9])(?!\d)", lambda m, s=shift: f"\\{int(m[1]) + s}", p))
        shift += re.compile(p.replace("++", "+")).groups
    any_of = "|".join(parts)
    t = f"`{text}`"
    held = docs.sparkSession.createDataFrame([(key,)], f"{KEY} string")
    out = docs.withColumn(KEY, held.scalar())
    out = out.withColumn("_q_m", F.expr(f"CASE WHEN {t} RLIKE '[0-9@]|::' THEN regexp_extract_all({t}, {_q(any_of)}, 0) ELSE array() END"))
    out = out.withColumn("_q_r", F.expr(f"transform(_q_m, m -> {pseudonym('m', inverse)})"))
    rebuilt = f"array_join(zip_with(split({t}, {_q(any_of)}, -1), _q_r, (g, r) -> concat(g, coalesce(r, ''))), '')"
    out = out.withColumn("n_private", F.expr("cast(size(filter(zip_with(_q_m, _q_r, (m, r) -> m <> r), x -> x)) as long)"))
    return out.withColumn(text, F.expr(f"CASE WHEN n_private > 0 THEN {rebuilt} ELSE {t} END")).drop(KEY, "_q_m", "_q_r")


def key_of(spark: SparkSession) -> str:
    """The secret key of pseudonyms: the session's setting KEY_SETTING, else a random one made once a session, whose pseudonyms
    link within the session only and which nobody can undo later."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op4_pseudonyms(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the pseudonymised text and the number of values replaced, for all ``documents``."""
    return pseudonymise(docs.select("doc_id", "text"), key or key_of(docs.sparkSession)).select("doc_id", "text", "n_private")
