"""Operator 1 against a detector and permuter of every kind, written out in Python."""

import datetime
import hashlib
import ipaddress
import random

import regex

from brigade.llm import pii

KEY = "plain"
EVERY = regex.compile("|".join(f"(?:{p})" for p in pii.PATTERNS.values()))
DAY0 = datetime.date(1900, 1, 1)


def draw(n, *parts):
    return int(hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()[:n], 16)


def feistel(a, b, p, q, tag):
    for r in range(1, 11):
        a, b = ((a + draw(15, tag, r, b)) % p, b) if r % 2 else (a, (b + draw(15, tag, r, a)) % q)
    return a, b


def digits(d, tag):
    u, v = len(d) // 2, len(d) - len(d) // 2
    a, b = feistel(int(d[:u]), int(d[u:]), 10**u, 10**v, f"{tag}{len(d)}")
    return f"{a:0{u}d}{b:0{v}d}"


def only(m):
    return "".join(c for c in m if c in "0123456789")


def refill(m, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def shifted(text, kind, hexa):
    alphabets = ["0123456789abcdef"] if hexa else ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"]
    a, b = text[: len(text) // 2], text[len(text) // 2 :]

    def moved(x, other, r):
        out = ""
        for i, c in enumerate(x, 1):
            row = next((w for w in alphabets if c in w), None)
            out += c if row is None else row[(row.index(c) + draw(8, kind, r, i, len(a), len(b), other)) % len(row)]
        return out

    for r in range(1, 11):
        if r % 2:
            a = moved(a, b, r)
        else:
            b = moved(b, a, r)
    return a + b


def is_hex(s):
    return all(c in "0123456789abcdef" for c in s)


def secret(m):
    if m.startswith(("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")):
        n = 4
    elif m.startswith("sk-"):
        n = 3
    else:
        n = regex.match(r"(?i:bearer |[a-z_-]+[\"']? ?[:=] ?[\"']?)", m).end()
    body = m[n:]
    new = shifted(body, "secret", is_hex(body))
    while not is_hex(body) and is_hex(new):
        new = shifted(new, "secret", False)
    return m[:n] + new


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m):
    groups = m.split(" ")
    for g in range(len(groups), 0, -1):
        good = " ".join(groups[:g])
        c = good.replace(" ", "")
        if 15 <= len(c) <= 34 and mod97(c[4:] + c[:4]) == 1:
            body = c[4:]
            if len(only(body)) > 1:
                body = refill(body, digits(only(body), "iban"))
            it = iter(f"{c[:2]}{98 - mod97(body + c[:2] + '00'):02d}{body}")
            return "".join(" " if x == " " else next(it) for x in good) + m[len(good) :]
    return m


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def step(n):
    a, b = feistel(n // 4297, n % 4297, 17, 4297, "date")
    return a * 4297 + b


def number(y, m, d):
    try:
        return (datetime.date(int(y), int(m), int(d)) - DAY0).days
    except ValueError:
        return None


def date(m):
    at = lambda n: DAY0 + datetime.timedelta(n)
    form = "%Y-%m-%d" if m[4] == "-" else f"%d{m[2]}%m{m[2]}%Y"
    n = number(m[:4], m[5:7], m[8:]) if m[4] == "-" else number(m[6:], m[3:5], m[:2])
    if n is not None and 0 <= n < 73049:
        return at(step(n)).strftime(form)
    back = number(m[6:], m[:2], m[3:5]) if "/" in m and n is None else None
    if back is None or not 0 <= back < 73049:
        return m
    back = step(back)
    while at(back).day <= 12:
        back = step(back)
    return at(back).strftime("%m/%d/%Y")


def pseudonym(m):
    kinds = {k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m)}
    if "ip6" in kinds and len([x for x in m.split(":") if x]) < 3:
        return m
    if "mail" in kinds:
        name, at, host = m.partition("@")
        return shifted(name, "mail", False) + at + host
    if "ip6" in kinds:
        new = shifted(f"{int(ipaddress.IPv6Address(m)):032x}", "ip6", True)
        return ":".join(f"{int(new[i : i + 4], 16):x}" for i in range(0, 32, 4))
    if "secret" in kinds:
        return secret(m)
    if "iban" in kinds:
        return iban(m)
    if "ip" in kinds:
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if "ssn" in kinds:
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m
        a, b = feistel(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 989901, "ssn")
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if "date" in kinds:
        return date(m)
    d = only(m)
    if "phone" in kinds:
        if not 7 <= len(d) <= 15:
            return m
        code = regex.match(pii.CODES, d)
        head = 2 if m[0] == "0" else 1 if m[0] != "+" else len(code[0]) if code else 3
        return refill(m, d[:head] + digits(d[head:], "phone"))
    if 13 <= len(d) <= 19 and luhn(d) == 0:
        new = digits(d[:-1], "card")
        return refill(m, new + str(-luhn(new + "0") % 10))
    return m


def plainly(text):
    if text is None:
        return None, 0
    n = 0

    def one(m):
        nonlocal n
        new = pseudonym(m[0])
        n += new != m[0]
        return new

    return EVERY.sub(one, text), n


def samples():
    rnd = random.Random(9)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    low, num, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    out = []
    for _ in range(25):
        bban = pick("ABCDEFGHIJ" + num * 3, rnd.randint(12, 26))
        account = f"DE{98 - mod97(bban + 'DE00'):02d}{bban}"
        spaced = " ".join(account[i : i + 4] for i in range(0, len(account), 4))
        card = pick(num, rnd.randint(12, 18))
        card += str(-luhn(card + "0") % 10)
        out += [
            f"{pick(low + num + '._é', 9)}@x.example.org", f"token: {pick(hexa, 20)}", f"password={pick(hexa, 15)}g", f'"api_key" : {pick(low.upper() + low + num, 24)}', f"AKIA{pick(low.upper() + num, 16)}",
            f"sk-{pick(low + num, 30)}", f"Authorization: Bearer {pick(low + num, 20)}.{pick(low.upper(), 20)}.{pick(num, 4)}", account, spaced + " PLUS", card, "-".join(card[i : i + 4] for i in range(0, len(card), 4)),
            ".".join(str(rnd.randint(0, 280)) for _ in range(4)), ":".join(pick(hexa, 4) for _ in range(8)), f"{pick('123', 4)}::{pick(hexa, 2)}:{pick(hexa, 3)}", f"std::{pick(hexa, 2)}", f"{rnd.randint(0, 999):03d}-{rnd.randint(0, 99):02d}-{rnd.randint(0, 99):04d}",
            f"+{rnd.randint(1, 999)} {pick(num, 3)} {pick(num, 3)} {pick(num, 4)}", f"({rnd.randint(200, 999)}) {pick(num, 3)}-{pick(num, 4)}", "0" + pick("123456789", 1) + "".join("." + pick(num, 2) for _ in range(4)), pick(num, 10),
            *(d.strftime(f) for d in [DAY0 + datetime.timedelta(rnd.randint(-400, 73400))] for f in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y")), f"{rnd.randint(1, 39):02d}/{rnd.randint(1, 19):02d}/20{pick(num, 2)}",
        ]
    return [*out, "bearer of responsibilities-everywhere here", "", None, " and ".join(out)]


def test_every_kind(spark):
    said = samples()
    t = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for r in pii.pseudonymise(t, key=KEY, count="n").collect():
        assert (r.text, r.n) == plainly(said[r.doc_id]), said[r.doc_id]


def test_whole_documents(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = {r.doc_id: r.text for r in t.collect()}
    got = pii.pseudonymise(t, key=KEY, count="n").collect()
    assert {r.doc_id: (r.text, r.n) for r in got} == {i: plainly(x) for i, x in said.items()}
    assert sum(r.n for r in got) > 50


def test_secrets_stay_different(spark):
    """Every secret of one letter beyond f and fifteen digits, and hexadecimal ones, beside each other."""
    bodies = [f"{i:015d}"[:15] + "g" for i in range(800)] + [f"{i:016x}" for i in range(0, 1600, 2)]
    t = spark.createDataFrame([(i, f"token={b}") for i, b in enumerate(bodies)], "doc_id long, text string")
    got = {r.doc_id: r.text[6:] for r in pii.pseudonymise(t, key=KEY).collect()}
    assert len(set(got.values())) == 1600 and all(is_hex(got[i]) == is_hex(b) for i, b in enumerate(bodies))
