import random
import re
import time

import pytest

from tablewright.llm.pii import KINDS, _redacted, find, find_pii, redact, written

# The base rules as they are stated, with a plain regular expression engine.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute(text):
    digits = lambda m: [int(c) for c in m.group() if c in "0123456789"]
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def test_base_rules():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choices("ab@..-+ 0123()9é", k=draw.randint(0, 40)))
        assert find(text)[0] == brute(text), text


def added(text):
    base, found = find(text)
    return [(kind, text[s:e]) for kind in KINDS for s, e in found[kind] if (s, e) not in base[kind]]


@pytest.mark.parametrize(("text", "expected"), [
    ("mail john.doe [at] example [dot] com now", [("email", "john.doe [at] example [dot] com")]),
    ("user(at)host.org", [("email", "user(at)host.org")]),
    ("write to jane dot roe at mail dot example dot com please", [("email", "jane dot roe at mail dot example dot com")]),
    ("j\u043ehn@ex\u0430mple.com", [("email", "j\u043ehn@ex\u0430mple.com")]),
    ("a\u200blice@exa\u200bmple.com", [("email", "a\u200blice@exa\u200bmple.com")]),
    ("ip one nine two dot one six eight dot one dot one end", [("ip", "one nine two dot one six eight dot one dot one")]),
    ("call plus four nine one five one two three four five six seven eight nine ok", [("phone", "plus four nine one five one two three four five six seven eight nine")]),
    ("four nine two nine three four eight three eight five one four six three zero six", [("card", "four nine two nine three four eight three eight five one four six three zero six")]),
    ("\uff14\uff19\uff12\uff19 \uff13\uff14\uff18\uff13 \uff18\uff15\uff11\uff14 \uff16\uff13\uff10\uff16", [("card", "\uff14\uff19\uff12\uff19 \uff13\uff14\uff18\uff13 \uff18\uff15\uff11\uff14 \uff16\uff13\uff10\uff16")]),
])
def test_disguises(text, expected):
    assert added(text) == expected


@pytest.mark.parametrize("text", ["we met at noon and put a dot there", "one two three four five six", "f(a)t [at] 3", "un deux trois quatre", "look at example dot", "Größe · naïve façade", "a.b@c.de plain"])
def test_plain_prose_is_left_alone(text):
    assert added(text) == []


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "one " * 50_000, "a at b dot " * 20_000, "(at) " * 40_000, "a@" * 100_000])
def test_no_text_is_slow(text):
    began = time.process_time()
    find(text)
    assert time.process_time() - began < 10


def test_tables(spark):
    rows = [(1, "x a@b.co y 10.0.0.1", "z"), (2, None, "z"), (3, "", "z"), (1, "x a@b.co y 10.0.0.1", "z"), (None, "\U0001f600 q@r.st", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {}
    for r in find_pii(docs).collect():
        got.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["base"]])
        assert r["base"] == r["found"]
    assert got == {1: [[("email", 2, 8), ("ip", 11, 19)]] * 2, 2: [[]], 3: [[]], None: [[("email", 2, 8)]]}
    assert written(find(rows[0][1])[1]) == "email:2:8,ip:11:19"
    clean = redact(docs)
    assert clean.columns == docs.columns
    assert [r["text"] for r in clean.orderBy("doc_id").collect()][1:] == ["x [email] y [ip]"] * 2 + [None, ""]
    assert find_pii(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "expected"), [
    ("аlice@example.com", ["аlice@example.com"]),
    ("alice@exаmple.com", ["alice@exаmple.com"]),
    ("to alice@example.cоm now", ["alice@example.cоm"]),
    ("j​ohn [a​t] ex.com", ["j​ohn [a​t] ex.com"]),
    ("bob (at) site dot com", ["bob (at) site dot com"]),
    ("bob at site [dot] com", ["bob at site [dot] com"]),
    ("bob@site dot com", ["bob@site dot com"]),
    ("\U0001d41bob@site.com, ok", ["\U0001d41bob@site.com"]),
    ("+49 (0) one five one 2345 six seven", ["+49 (0) one five one 2345 six seven"]),
    ("Ｋim ［at］ host.org", ["Ｋim ［at］ host.org"]),
])
def test_steps_compose_and_whole_spans_stand_beside_base_spans(text, expected):
    base, found = find(text)
    assert [text[s:e] for _, s, e in ((k, *x) for k in KINDS for x in found[k] if x not in base[k])] == expected
    assert all(set(base[k]) <= set(found[k]) for k in KINDS)
    left = _redacted(text)
    assert not any(part in left for part in ("alice", "lice", "ohn", "bob", "ob@", "five", "host"))


@pytest.mark.parametrize("text", ["look at example.com", "put a dot bob@site.com", "we looked at it. dot com was here", "x​y [at] 3"])
def test_prose_and_plain_addresses_gain_nothing(text):
    assert added(text) == []


def disguised(draw, kind, plain):
    """The identifier in a disguise chosen at random: several at once, in any mixture."""
    if kind == "email":
        name, domain = plain.split("@")
        style = draw.choice(["plain", "marks", "bare"])
        dot = {"plain": lambda: ".", "marks": lambda: draw.choice([" [dot] ", "(.)", "{dot}", "[punkt]", "."]), "bare": lambda: " dot "}[style]
        at = {"plain": "@", "marks": draw.choice([" [at] ", "(at)", "<@>", " {arroba} "]), "bare": draw.choice([" at ", "(at)"])}[style]
        text = name + at + "".join(dot() if c == "." else c for c in domain)
    else:
        text = plain
        if draw.random() < 0.6:
            names = draw.choice(["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve"]).split()
            text = " ".join(names[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in plain)
    swaps = {"a": "а", "o": "о", "e": "е", "p": "\U0001d5c9", "c": "с", "1": "１", "7": "٧"}
    out = ""
    for i, c in enumerate(text):
        out += draw.choice([c, swaps[c]]) if c in swaps and draw.random() < 0.4 else c
        if i < len(text) - 1 and c.isalnum() and draw.random() < 0.1:
            out += draw.choice("​⁠­")
    return out


def test_disguised_identifiers_are_found_where_they_are():
    draw = random.Random(4)
    letters = "abcdefghiklmnopqrstuvwxyz"
    for _ in range(4000):
        kind = draw.choice(["email", "phone", "card", "ip"])
        if kind == "email":
            plain = "".join(draw.choices(letters, k=6)) + "@" + ".".join("".join(draw.choices(letters, k=draw.randint(4, 7))) for _ in range(draw.randint(1, 2))) + draw.choice([".com", ".org", ".de"])
        elif kind == "ip":
            plain = ".".join(str(draw.randrange(256)) for _ in range(4))
        elif kind == "phone":
            plain = "+" + "".join(draw.choices("0123456789", k=12))
        else:
            body = "".join(draw.choices("123456789", k=15))
            plain = next(body + d for d in "0123456789" if luhn([int(c) for c in body + d]))
        text = disguised(draw, kind, plain)
        before, after = draw.choice(["see ", "x: ", "\U0001f600 ", ""]), draw.choice([" now", "\nend", " é", ""])
        base, found = find(before + text + after)
        assert (len(before), len(before) + len(text)) in found[kind], (kind, plain, text)
        assert all(set(base[k]) <= set(found[k]) for k in KINDS)
