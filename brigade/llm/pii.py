"""Operator 1: format-preserving Feistel pseudonyms for personal data. DataFrame functions only.

Every expression is SQL text put together here once, on the driver; nothing runs in Python later.
A value is replaced by a keyed permutation within its own format, so equal values stay equal in
every document, different values stay different, and the pseudonym passes the same validation.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

ROUNDS = 10
SECRET = "spark.brigade.pii.secret"

#: What each kind looks like. The first that matches at a place counts; mail and secrets apart, all are validated.
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}-])",
    "secret": r"(?i:(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']? ?[:=] ?[\"']?)[A-Za-z0-9+/_=-]{16,512}+|(?<![A-Za-z0-9])(?:AKIA|ASIA|gh[pousr]_)[A-Za-z0-9]{16,64}+|(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,200}+|(?<![A-Za-z0-9])(?i:bearer) (?=[A-Za-z._~+/=-]{0,64}[0-9])[A-Za-z0-9._~+/=-]{20,4096}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,5}|\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9]([ .-])[0-9]{2}(?:\1[0-9]{2}){3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
}
#: Country calling codes are of one digit, of these two, or of three: the code of a number needs no separator.
CODES = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, mod_a: str, mod_b: str, tag: str, key: str) -> str:
    """SQL for a struct (a, b): alternating keyed additions to either half, a bijection of the pairs."""
    f = f"cast(conv(substr(sha2(concat_ws('|', {_lit(key)}, {tag}, r, %s), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> "
        f"if(r % 2 = 1, named_struct('a', (s.a + {f % 's.b'}) % {mod_a}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f % 's.a'}) % {mod_b})))"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(d: str, tag: str, key: str) -> str:
    """SQL permuting a string of 2 to 36 digits within its length."""
    u, v = f"cast(length({d}) div 2 as int)", f"cast(length({d}) - length({d}) div 2 as int)"
    p, q = f"cast(pow(10, {u}) as bigint)", f"cast(pow(10, {v}) as bigint)"
    pair = _feistel(f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", p, q, f"concat({tag}, length({d}))", key)
    return _let("z", pair, f"concat(lpad(cast(z.a as string), {u}, '0'), lpad(cast(z.b as string), {v}, '0'))")


def _only(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """SQL for ``m`` with its digits replaced in order by those of ``digits``."""
    return _let("w", digits, f"array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) between '0' and '9', substr(w, length({_only(f'substr({m}, 1, i)')}), 1), substr({m}, i, 1))), '')")


def _luhn(d: str) -> str:
    """SQL for the Luhn sum of a digit string."""
    return f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9), 1 + cast(substr({d}, i, 1) as int) + 10 * ((length({d}) - i) % 2)))"


def _mod97(s: str) -> str:
    """SQL for an account number's remainder by 97, letters counting from 10."""
    value = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({s}, i, 1)) - 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, i) -> (t * if({value} > 9, 100, 10) + {value}) % 97)"


def _shifted(text: str, kind: str, hexa: str, key: str) -> str:
    """SQL shifting the letters and digits of a string, each within its alphabet (where ``hexa`` holds
    within the hexadecimal digits): a Feistel network over the two halves of the string, the shifts
    of one half drawn from the other. Other characters stay."""
    shift = f"cast(conv(substr(sha2(concat_ws('|', {_lit(key)}, {kind}, r, i, length(s.a), length(s.b), if(r % 2 = 1, s.b, s.a)), 256), 1, 8), 16, 10) as bigint)"
    # of each alphabet its first place and its size among these characters; the place of a character in all of them
    row = "0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    first = f"case when {hexa} and c between '0' and '9' or {hexa} and c between 'a' and 'f' then struct(0, 16) when c between 'A' and 'Z' then struct(16, 26) when c between 'a' and 'z' then struct(42, 26) when c between '0' and '9' then struct(68, 10) end"

    def moved(x: str) -> str:
        at = f"instr(substr('{row}', f.col1 + 1, f.col2), c) - 1"
        one = _let("f", first, f"if(f is null, c, substr('{row}', 1 + f.col1 + cast(({at} + {shift}) % f.col2 as int), 1))")
        return f"array_join(transform(sequence(1, length({x})), i -> {_let('c', f'substr({x}, i, 1)', one)}), '')"

    start = f"named_struct('a', substr({text}, 1, length({text}) div 2), 'b', substr({text}, length({text}) div 2 + 1))"
    # a string of one character has no first half, and then only the second one moves
    step = f"if(r % 2 = 1, named_struct('a', if(s.a = '', '', {moved('s.a')}), 'b', s.b), named_struct('a', s.a, 'b', {moved('s.b')}))"
    return _let("z", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step})", "concat(z.a, z.b)")


def _named(m: str, key: str, is_: dict) -> str:
    """SQL for mail addresses (what stands before the @ is shifted), secrets (the value behind a name and
    its sign, or behind the four letters that mark a key), and IPv6 addresses, whose 32 hexadecimal
    digits are shifted and written in full, without leading zeros."""
    named = r"^(?i:bearer |[a-z_-]+[\"\']? ?[:=] ?[\"\']?)"
    head = f"case when {m} rlike '^(?:AKIA|ASIA|gh[pousr]_)' then substr({m}, 1, 4) when {m} like 'sk-%' then 'sk-' else regexp_extract({m}, {_lit(named)}, 0) end"
    gap = f"array_repeat('0', 8 - size(filter(split({m}, ':'), x -> x <> '')))"
    parts = f"if({m} like '%::%', concat(split(substring_index({m}, '::', 1), ':'), {gap}, split(substring_index({m}, '::', -1), ':')), split({m}, ':'))"
    cut = (
        f"case when {is_['mail']} then named_struct('kind', 'mail', 'head', '', 'body', substring_index({m}, '@', 1), 'tail', substr({m}, instr({m}, '@'))) "
        f"when {is_['ip6']} then named_struct('kind', 'ip6', 'head', '', 'body', lower(array_join(transform({parts}, x -> lpad(x, 4, '0')), '')), 'tail', '') "
        f"else {_let('head', head, f"named_struct('kind', 'secret', 'head', head, 'body', substr({m}, length(head) + 1), 'tail', '')")} end"
    )
    written = "array_join(transform(sequence(1, 29, 4), i -> coalesce(nullif(ltrim('0', substr(w, i, 4)), ''), '0')), ':')"
    hexa = "(u.kind = 'ip6' or u.kind = 'secret' and not u.body rlike '[^0-9a-f]')"
    # a mixed secret goes on along its cycle past what a hexadecimal one may become; 64 steps miss with a chance of 2**-135
    mixed = "t rlike '^[0-9a-f]*$' and u.kind = 'secret' and u.body rlike '[^0-9a-f]'"
    walk = f"aggregate(sequence(1, 64), {_shifted('u.body', 'u.kind', hexa, key)}, (t, k) -> if({mixed}, {_shifted('t', 'u.kind', 'false', key)}, t))"
    return _let("u", cut, _let("w", walk, f"if(u.kind = 'ip6', {written}, concat(u.head, w, u.tail))"))


def _date(m: str, key: str) -> str:
    """SQL permuting the days from 1900 to 2099 (73,049 = 17 x 4,297 of them). With slashes the day
    comes first; what is a date only with the month first goes on along its cycle to such a date."""
    form = f"case when {m} like '____-%' then 'yyyy-MM-dd' when {m} like '%/%' then 'dd/MM/yyyy' else 'dd.MM.yyyy' end"
    y = f"if({m} like '____-%', substr({m}, 1, 4), substr({m}, 7, 4))"
    mo = f"if({m} like '____-%', substr({m}, 6, 2), substr({m}, 4, 2))"
    d = f"if({m} like '____-%', substr({m}, 9, 2), substr({m}, 1, 2))"
    n = f"datediff(try_cast(concat_ws('-', {y}, {mo}, {d}) as date), date'1900-01-01')"
    step = lambda day: _let("z", _feistel(f"{day} div 4297", f"{day} % 4297", "17", "4297", "'date'", key), "cast(z.a * 4297 + z.b as int)")
    on = lambda day: f"date_add(date'1900-01-01', {day})"
    new = f"date_format({on(step('day'))}, {form})"
    back = f"datediff(try_cast(concat_ws('-', substr({m}, 7, 4), substr({m}, 1, 2), substr({m}, 4, 2)) as date), date'1900-01-01')"
    # two of five days are up to the twelfth: 64 steps miss with a chance of 2**-85, and then the date stays
    found = f"named_struct('day', t, 'done', dayofmonth({on('t')}) > 12)"
    walk = f"aggregate(sequence(1, 64), named_struct('day', back, 'done', false), (u, k) -> if(u.done, u, {_let('t', step('u.day'), found)}))"
    ended = _let("u", walk, f"if(u.done, date_format({on('u.day')}, 'MM/dd/yyyy'), {m})")
    month_first = _let("back", back, f"if(back between 0 and 73048, {ended}, {m})")
    return _let("day", n, f"case when day between 0 and 73048 then {new} when {m} like '%/%' and day is null then {month_first} else {m} end")


def _pseudonym(m: str, key: str) -> str:
    """SQL for what takes the place of a match; a match that fails its validation stays."""
    octet = lambda i: f"cast(element_at(split({m}, '[.]'), {i}) as bigint)"
    ip = _let("z", _feistel(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536", "'ip'", key), "concat_ws('.', z.a div 256, z.a % 256, z.b div 256, z.b % 256)")
    # what the form demands stays: a calling code, a national prefix with its zero, an area code's first digit
    phone_head = f"case when substr({m}, 1, 1) = '0' then 2 when substr({m}, 1, 1) <> '+' then 1 when all rlike {_lit(CODES)} then length(regexp_extract(all, {_lit(CODES)}, 0)) else 3 end"
    phone = _let("all", _only(m), _let("head", phone_head, _refill(m, f"concat(substr(all, 1, head), {_digits('substr(all, head + 1)', _lit('phone'), key)})")))
    card_new = _let("p", _digits(f"substr({_only(m)}, 1, length({_only(m)}) - 1)", _lit("card"), key), f"concat(p, (10 - {_luhn("(concat(p, '0'))")} % 10) % 10)")
    iban_body = _let("body", "substr(c, 5)", f"if(length({_only('body')}) > 1, {_refill('body', _digits(_only('body'), _lit('iban'), key))}, body)")
    iban_new = _let("bban", iban_body, f"concat(substr(c, 1, 2), lpad(cast(98 - {_mod97("concat(bban, substr(c, 1, 2), '00')")} as string), 2, '0'), bban)")
    # of a number in groups the longest run of groups that is valid; a word in capitals may follow it
    valid = f"length(c) between 15 and 34 and {_mod97('concat(substr(c, 5), substr(c, 1, 4))')} = 1"
    runs = f"transform(reverse(sequence(1, size(split({m}, ' ')))), g -> substring_index({m}, ' ', g))"
    good = f"get(filter({runs}, x -> {_let('c', "replace(x, ' ', '')", valid)}), 0)"
    spaced = "array_join(transform(sequence(1, length(good)), i -> if(substr(good, i, 1) = ' ', ' ', substr(w, length(replace(substr(good, 1, i), ' ', '')), 1))), '')"
    iban = _let("good", good, f"if(good is null, {m}, {_let('c', "replace(good, ' ', '')", _let('w', iban_new, f"concat({spaced}, substr({m}, length(good) + 1))"))})")
    area, group, serial = (f"cast(substr({m}, {i}, {n}) as bigint)" for i, n in ((1, 3), (5, 2), (8, 4)))
    ssn = _let("z", _feistel(f"{area} - if({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", "'ssn'", key), "concat_ws('-', lpad(cast(z.a + if(z.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(z.b div 9999 + 1 as string), 2, '0'), lpad(cast(z.b % 9999 + 1 as string), 4, '0'))")
    is_ = {k: f"{m} rlike {_lit('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    return (
        f"case when {is_['ip6']} and size(filter(split({m}, ':'), x -> x <> '')) < 3 then {m} "
        f"when {is_['mail']} or {is_['secret']} or {is_['ip6']} then {_named(m, key, is_)} "
        f"when {is_['iban']} then {iban} "
        f"when {is_['ip']} then if(forall(split({m}, '[.]'), o -> cast(o as int) < 256), {ip}, {m}) "
        f"when {is_['ssn']} then if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {ssn}, {m}) "
        f"when {is_['date']} then {_date(m, key)} "
        f"when {is_['phone']} then if(length({_only(m)}) between 7 and 15, {phone}, {m}) "
        f"when length({_only(m)}) between 13 and 19 and {_luhn(_only(m))} % 10 = 0 then {_refill(m, card_new)} "
        f"else {m} end"
    )


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``count`` names a column for how many were.

    ``key`` is the secret of the permutations: who has it can reverse them, and without it pseudonyms
    of two runs don't match. It stands in the query's plan, so keep plans as closely as the key.

    Handled: mail addresses, account numbers (IBAN, mod 97, solid or in groups), IPv4 and IPv6
    addresses, telephone numbers (with a calling code, or in groups), US social security numbers,
    dates from 1900 to 2099, card numbers (Luhn), values named as a token, secret, password or
    key, bearer tokens, and keys marked by AKIA, ASIA, ghp_ and its like, or sk-. Left alone: MAC
    addresses and telephone numbers without a code or separators. Equal values get equal pseudonyms however they are grouped; a number with its calling code
    isn't linked to one without, nor a date with the month first to other forms. What fails its
    validation is left alone, and so is every other byte of the text. Rows are neither shuffled nor
    dropped. Null texts stay null (count 0), empty texts empty; all other columns pass unchanged,
    whatever their names. Repeated rows give repeated results.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    every = "|".join(f"(?:{p})" for p in PATTERNS.values())
    t = _name(text)
    work = f"named_struct('m', regexp_extract_all({t}, {_lit(every)}, 0), 'gaps', split({t}, {_lit(every)}, -1))"
    new = f"transform(q.m, m -> {_pseudonym('m', key)})"
    joined = _let("n", new, "named_struct('text', concat(array_join(transform(n, (x, i) -> concat(q.gaps[i], x)), ''), element_at(q.gaps, -1)), 'n', size(array_except(array_distinct(transform(n, (x, i) -> if(x <> q.m[i], i, -1))), array(-1))))")
    done = F.expr(f"if({t} rlike '[0-9@:=]', {_let('q', work, joined)}, named_struct('text', {t}, 'n', 0))")
    own = "pii"
    while own in {c.lower() for c in docs.columns}:  # a name that no column has
        own += "_"
    out = docs.withColumn(own, done)
    cols = [F.col(f"{own}.text" if c == text else _name(c)).alias(c) for c in docs.columns]
    return out.select(*cols, *([F.coalesce(F.col(f"{own}.n"), F.lit(0)).cast("long").alias(count)] if count else []))


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def secret(spark: SparkSession) -> str:
    """The session's key, ``spark.brigade.pii.secret``; where none is set, one is drawn for this session,
    whose pseudonyms can't be linked to those of another."""
    if not spark.conf.get(SECRET, None):
        spark.conf.set(SECRET, secrets.token_hex(32))
    return spark.conf.get(SECRET)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key=secret(spark), count="n_pseudonyms")
