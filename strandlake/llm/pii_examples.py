"""A small labelled table for the personal-data model: texts whose spans are marked as [kind:text].

All names, addresses and numbers are invented or reserved for documentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Hand-written lines.
LINES = (
    "Please write to [email:anna.lee@mail.example.com] before noon.",
    "Contact: [email:j_doe+news@example.org], or ask at the desk.",
    "mail me <[email:zoë.müller@example.net]> about the garden",
    "la lettre de [email:rené.26@mail6.example.com] est ici",
    "de la casa [email:niño.07@mail2.example.com] con ella",
    "Und dann [email:größe.34@mail7.example.com] mit der",
    "the word of.12@home is not one, [email:the.99@mail9.example.com] is",
    "From: [email:support@shop.example.co.uk]; To: [email:pat.kim@example.com].",
    "reach [email:käthe@bücher.example] or [email:bob99@example.io] by Friday",
    "(see [email:team-lead@dev.example.com])",
    "follow @anna or @bob_99 on the network",
    "we met @ 5 o'clock @ the station",
    "price 5@10 each, sum 50",
    "int x = a@b; @Override public void run",
    "The host [ip:192.168.10.24] answered twice.",
    "ping [ip:10.0.0.1] and [ip:172.16.254.3], then stop",
    "from [ip:203.0.113.77]:8080 to port 443",
    "address [ip:2001:db8:0:1::7] was seen in the log",
    "route via [ip:fe80::1ff:fe23:4567:890a] is down",
    "neighbours [ip:2001:db8:85a3::8a2e:370:7334], [ip:fd00::1] and more",
    "client ([ip:198.51.100.200]) closed the door",
    "inside of [ip:85.134.245.158] uedo ando con",
    "Version 2.0 of the licence, section 3.1.4 applies",
    "see chapter 1.2.3 and figure 10.4",
    "v1.2.3.4567 came out, then 2.10.0.1024",
    "Licensed under CC BY-NC 4.0.",
    "the GNU General Public License, version 3.",
    "at 10:30:45 the clock 12:05 stopped",
    "ratio 3:4:5 and std::vector a::b",
    "MAC 00:1a:2b:3c:4d:5e was printed on it",
    "Card [card:4539 1488 0343 6467] was charged.",
    "paid with [card:5500-0000-0000-0004], thanks",
    "use [card:4111.1111.1111.1111] for the test",
    "number [card:4012_8888_8888_1881] in the form",
    "card [card:3782/822463/10005] expired",
    "charged 4736962573099581 at the counter",
    "inha 4736962573099582 ble on the hill",
    "[card:6011111111111117] is on file and [card:30569309025904] too",
    "numéro [card:4222.2222.2222.2] à la caisse",
    "order 2024-000123-445566 shipped, invoice 0001-0002",
    "tracking 1Z999AA10123456784 is on its way",
    "serial 12.3456.7890.12 of the pump",
    "account 12345678901234567890123 closed",
    "between 1914 1918 1939 1945 and 2024 2025",
    "table 10 20 30 40 50 60 70 80 of values",
    "Call [phone:+1 (212) 555-0143] today.",
    "rethsh [phone:+1 (017) 555-7713] on toon",
    "phone [phone:(415) 555-0199] or [phone:415-555-0123]",
    "Tel. [phone:212.555.0187], ask for Sam",
    "ring [phone:0049 30 901820] in the morning",
    "Telefon [phone:030/901820-44] bis acht Uhr",
    "numéro [phone:06 12 34 56 78] après six heures",
    "fax [phone:+44 20 7946 0958]; office [phone:+49-89-636-48018]",
    "mobile [phone:07700 900123] is mine",
    "llamar al [phone:(91) 555 01 23] por la tarde",
    "his number, [phone:555-0143], rang out",
    "[phone:1-800-555-0100] is free of charge",
    "on 2024-05-17 and 17.05.2024 we met",
    "from 05/17/2024 to 06/01/2024 it rained",
    "pages 120-145 and 300-312 are missing",
    "it cost $1,299.00 or 1.299,00 in total",
    "a score of 3-2 (2-1) at half time",
    "temperature -12.5 to +30.2 degrees",
    "x = (a + b) * 2 - 10 (mod 7)",
    "born in (1984) and moved in (2001)",
    "item (12) of list (3) and note [4]",
    "ISBN 978-3-16-148410-0 is a book",
    "the year 1999 had 365 days and 12 months",
    "section (a) of part [b] says so",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thhantou',
    'secret = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"!! end',
    "sha 9f86d081884c7d659a2feaa0c55ad015 of file",
    "id 123e4567-e89b-12d3-a456-426614174000 was new",
    "ARRR THE. 12!! ZUVER!! 77!! GEHEIT!!",
    "area code 212 and zip 10001-1234",
    "room 101, floor 3, house 42b, km 7",
    "flight LH 454 at gate B12 leaves 18:45",
    "10% of 200 is 20, 5% is 10",
    "1. first 2. second 3. third",
    "A4 paper, B2B trade, 3D print, 5G net",
    "https://example.com/a/b?id=12345 and http://example.org:8080/x",
    "C:\\tmp\\file_001.txt has 4096 bytes",
    "the quick brown fox jumps over the lazy dog",
    "él está aquí, ella no; mañana será otro día",
    "der große Bär läuft über die schöne Brücke",
    "lat 52.5200 lon 13.4050 near the river",
    "{\"k\": 17, \"v\": [1, 2, 3]} was read",
    "rows 1,024 to 2,048 of 1,000,000",
    "1/2 cup, 3/4 spoon, 2x4 boards, 10x",
    "E = 6.62e-34 and N = 6.022e23",
)

_MARK = re.compile(r"\[(email|ip|card|phone):((?:[^\[\]])*)\]")


def luhn(digits: str) -> bool:
    n = [int(c) for c in reversed(digits)]
    return sum(n[::2] + [d * 2 - 9 * (d > 4) for d in n[1::2]]) % 10 == 0


def parsed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A line's text and its spans."""
    text, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        text += line[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def varied(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The line with other digits and letters of the same kind; lengths, spans and checksums of cards stay."""
    out = [str(rng.integers(1, 10)) if c in "123456789" else chr(97 + rng.integers(26)) if "a" <= c <= "z" else c for c in text]
    for kind, a, b in spans:
        if kind == "ip":
            out[a:b] = text[a:b]
        if kind == "card":
            last = max(i for i in range(a, b) if out[i].isdigit())
            digits = lambda: "".join(c for c in out[a:b] if c.isdigit())  # noqa: B023, E731
            out[last] = next(d for d in "0123456789" if luhn(digits()[:-1] + d))
    return "".join(out), spans


def table(variants: int = 3, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """All lines, each with ``variants`` varied copies."""
    rng = np.random.default_rng(seed)
    lines = [parsed(line) for line in LINES]
    return lines + [varied(*line, rng) for line in lines for _ in range(variants)]
