"""Personal data in free text: a skip-chain conditional random field over candidate windows.

Only tokens inside a window around something that could be personal data are labelled; every other token is fixed to
"outside", which splits the chain into independent windows without changing its optimum. Tokens are abstracted to
cue words and shapes, so equal windows are decoded once per worker. Windows of one text that repeat a capitalised
word are tied by skip edges and decoded together by loopy message passing.

The field is fitted on sentences written by the generator below; no corpus row is used for fitting.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.crf import ChainCRF, slot

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: Tokens kept on each side of a candidate, and training sentences.
SIDE, SENTENCES = 6, 2000
#: Rewards of a skip edge among which the fit chooses, on generated texts that repeat a name.
SKIPS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
_CACHE_MAX = 200_000

_T = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:['’-][A-Z]?[a-zà-öø-ÿ]+)*"
# Each pattern begins with a small character set, so texts are scanned at the speed of that set.
_CANDIDATES = [
    re.compile(r"@|\(at\)|\[at\]| at (?=[\w.-]+(?:\.| dot )\w)"),
    re.compile(r"\d[\d().\-/ ]{5,}\d"),
    re.compile(r"\d,? (?=[A-Z][a-z])"),
    re.compile(rf"{_T},? (?:(?:[A-Z]\.|von|van|de|da|del|la|bin|al) )*{_T}(?!\w)"),
]
_TOKEN = re.compile(
    r"(?P<pkg>@[\w.-]+/[\w.-]+(?:@[\w.-]+)?)|(?P<mail>[\w.+%-]+(?:@|\(at\)|\[at\])[\w-]+(?:(?:\.|\(dot\)|\[dot\])[\w-]+)+)|(?P<handle>@\w+)"
    rf"|(?P<title>{_T}(?![\w]))|(?P<id>[A-Z]{{1,2}}\d[\d-]+[A-Z]?(?!\w)|\d{{6,}}[A-Z](?!\w))|(?P<num>\+?\d[\d.\-/]*\d(?!\w)|\+?\d(?!\w))|(?P<word>\w+)|(?P<nl>\n)|(?P<other>[^\w\s])"
)
# Words whose identity, not only shape, is a feature.
_CUES = frozenset(
    """address author ask avenue ave at bit board by call calle cc clone commit contact contacted desk dear decorator dot driver driving email
    finished fixture flat flush from gate hangs harbor hello here hi home id identity in install insurance is it lane laptop licence license line lines live lives
    mail mailed mailto maintainer me met mine mistake mobile moved mr mrs ms dr my name named national ni no notify number office on owner on-call oncall paired
    passport phone piazza ping place plan platz please port prof reach regards report restarted road rd rue row rows run sample said seeded seen sms send sent service
    shift ship show shows signed ssn social st street strasse straße talked tax teacher tel telephone test text texted the this to user version via visited was weg went who with wrote
    zip reviewed reviewed-by review seconds ms s lines port host ip beats wins says asked told thanks escalate escalated reply replied forwarded gateway pin code ticket
    order invoice batch build hash revision team guide learning machine release error chart figure section table round ssn dni steuernummer fax am approved merged found fixed reported joined called thinks wants knows left signed spoke reviewer assignee editor manager reply_to support
    home court square boulevard way avenida heiße llamo llama mi fragen bitte al in der ich me please de la del von van der den bei unter nummer telefon anrufen adresse name heißt wohnt correo teléfono llamar dirección vive nombre""".split()
)
_STREET = ("strasse", "straße", "weg", "gasse", "platz", "allee", "damm", "laan", "straat")


def tokens(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, abstraction)`` of every token."""
    out = []
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        low = s.lower()
        if kind == "title":
            a = "K:" + low if low in _CUES else "Tstr" if low.endswith(_STREET) and len(low) > 6 else "T"
        elif kind == "word":
            if low in _CUES:
                a = "k:" + low
            elif len(s) == 1 and s.isupper():
                a = "I"
            elif s.isupper() and s.isalpha():
                a = "U"
            elif "_" in s:
                a = "x_x"
            elif any(c.isdigit() for c in s):
                a = "w9"
            elif not s.islower() and s.isascii():
                a = "Cc"
            else:
                a = "w" if s.isascii() or not s[:1].isalpha() or s.islower() else "字"
        elif kind in ("num", "id"):
            a = re.sub(r"[A-Z]", "X", re.sub(r"\d", "9", s))[:18]
        elif kind == "mail":
            local = re.split(r"@|\(at\)|\[at\]", s)[0].lower()
            a = "MACHINE@" if local in ("git", "noreply", "no-reply", "root", "bot", "ci", "hg", "svn", "npm") else "MAIL"
        elif kind in ("pkg", "handle"):
            a = kind
        else:
            a = s
        out.append((m.start(), m.end(), kind, a))
    return out


def _features(abstract: list[str], space: list[bool]) -> list[list[int]]:
    n = len(abstract)
    get = lambda i: abstract[i] if 0 <= i < n else "∅"
    out = []
    for i in range(n):
        a, b, c = get(i), get(i - 1), get(i + 1)
        names = [f"0{a}", f"-{b}", f"+{c}", f"-0{b}|{a}", f"0+{a}|{c}", f"-2{get(i - 2)}", f"+2{get(i + 2)}", f"-+{b}|{a}|{c}", f"-2-{get(i - 2)}|{b}|{a}", f"++{a}|{c}|{get(i + 2)}", f"sp{space[i]}{a}"]
        names += [f"cue{get(j)}" for j in (i - 5, i - 4, i - 3) if get(j)[:2] in ("k:", "K:")]
        names += [f"after{get(j)}" for j in (i + 3, i + 4) if get(j)[:2] in ("k:", "K:")]
        out.append([slot(x) for x in names])
    return out


# --- Sentences for fitting: several small grammars. {N} name, {E} email, {P} phone, {I} identity number, {A} street address; `w` is
# any word, 9 any digit, Foo any capitalised word, x_x an identifier. A frame is a grammar's production with one value in it. ---

_ROLES = "Author Reviewer Reviewed-by Signed-off-by Co-authored-by Acked-by Tested-by Reported-by Assignee Owner Contact Maintainer Manager Editor Teacher".split()
_SAID = "said wrote asked told approved merged found fixed reported joined called sent thinks wants knows left signed asked".split()
_NEAR = ["by", "from", "with", "to", "for", "cc", "ask", "Ask", "met", "thanks to", "Thanks to", "according to", "spoke with", "Talked to", "paired with", "the laptop of", "written by", "reviewed by", "I know", "I paired with", "mit", "von", "de", "con", "para"]
_KEYS = {"N": "owner author name contact user assignee maintainer reviewer".split(), "E": "email mail contact from to notify cc reply_to author support".split(), "P": "phone tel mobile telephone sms fax call".split(), "I": "note remark row comment text".split(), "A": "address home ship_to office street".split()}
_LEAD = {
    "N": ["My name is {N}.", "my name is {N} and I w the w", "I am {N}, w w.", "This is {N}.", "{N} here.", "Hi {N}, w w", "Dear {N},", "Regards, {N}", "Regards,\n{N}", "Ich heiße {N}.", "Bitte {N} fragen.", "Me llamo {N}.", "Mi nombre es {N}.", "Fragen an {N}.", "cc {N}", "/cc {N}", "Dr. {N} w it."],
    "E": ["Send it to {E}.", "Send the w to {E} when w is w.", "Write to {E} about it.", "Reply to {E} please.", "mail {E} first", "My address is {E}, w there.", "You can reach me at {E}.", "Contact: {E}", "Author: <{E}>", "mailto:{E}", "<mailto:{E}>", "Ping {E} if it w.", "Ping mailto:{E} if w w w.", "contact={E};", "E-Mail an {E} schicken.", "Correo: {E}", "{E} has the w."],
    "P": ["Call me on {P}.", "Call me on {P} if the w w.", "You can reach me at {P} after w.", "Phone {P}.", "phone: {P}", "Number: {P}", "W number: {P}", "My mobile is {P}.", "tel {P}", "Text me at {P}", "Sms sent to {P}, w w.", "w w test sent to {P}, no w.", "Telefon: {P}", "Unter {P} anrufen.", "Llamar al {P}.", "Fax {P}"],
    "I": ["Mine is {I}, w w it.", "My {I} was in the w.", "Row 9 shows {I} in w.", "{I} was in the log.", "We saw {I} in the w.", "w w was w with {I} by w.", "Please mask {I}.", "id: {I}", "He sent {I}.", "w {I} w"],
    "A": ["address: {A}", "Address: {A}", "I live at {A}.", "Send it to {A}, please.", "Ship the w to {A}.", "The w uses my home, {A}, as w w.", "Our w moved to {A} w w.", "The office is at {A}.", "Adresse: {A}", "Ich wohne in der {A}.", "Dirección: {A}", "Vivo en {A}.", "We met at {A}."],
}
_WITHOUT = [
    "Run 9999999999 finished in 999-9999 ms.", "See lines 999-9999 of x_x.py.", "The Foo Tool service restarted at 99.9.999.99 port 99999.", "Clone git@w.w.test:w/w.git and w it.", "Use the @x_x decorator.", "Install @w/w@9.99.9 first.", "Foo Bar Team w it.", "The Foo Team w the Bar Guide.",
    "Foo Tool beats Bar Tool here.", "Commit 9a9b9c9d9e9f from 9999-99-99 99:99 is fine.", "99 passed, 9 failed in 99.99s", "My guess is that FooBarBaz w the w.", "x_x.py:999: w w", "Then FooBarBaz w 999 w, w followed by the w of w.", "Version 9.9.99 of the Foo Bar release.", "Ticket 9999999 and build 99999999 are done.",
    "Die Auswertung von FooBarBaz ist fertig.", "Order 99-999-9999 shipped by the Foo Bar service.", "ssh root@99.9.9.99 -p 9999", "Deploy at 99:99 on 9999-99-99.", "w w w 999 w w.", "The Foo Bar table has 9999 rows.", "checksum 99999999999999999999", "id 99999999-9999-9999-9999-999999999999", "Port Foo is closed.", "the Foo Road parser is w",
    "noreply@w.example sent 9 w", "min(x, default=999) - max(y, default=99)", "[99999, 99999, 99999]", "99999| x = 9", "Round 9, Table 99", "Section 99 Chart 9", "Table 99, Figure 9", "a Foo Bar at 99 Foo", "w w. Then Foo", "w w. Then Foo…", "w w w. Die Foo", "w w w. My Foo", "Then Foo Bar", "Die Foo…",
    "Foo Learning Team", "the Machine Foo paper", "New Foo Release", "Error 99999999 in Foo Bar", "Foo Street View is w.", "at 9999.99 USD, 99 Foo", "in Foo, 9999", "invoice 99-9999999", "pin 9999, code 999999",
]


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, title: bool = False, lo: int = 2, hi: int = 4) -> str:
        s = "".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiou") for _ in range(self.r.randint(lo, hi))) + self.r.choice(["", "n", "r", "s", "l"])
        return s.title() if title else s

    def digits(self, shape: str) -> str:
        return re.sub("9", lambda _: str(self.r.randint(0, 9)), shape)

    def letters(self, shape: str) -> str:
        """A shape of an identity number: X any capital letter, 9 any digit."""
        return self.digits(re.sub(r"(?<![a-z])X(?![a-z])", lambda _: self.r.choice("ABCDEFGHJKLMNPRSTVWXYZ"), shape))

    def frame(self, kind: str) -> str:
        """A production of one of the grammars: a lead, a line of a role, a clause, or a field of a configuration."""
        r, v = self.r, "{" + kind + "}"
        key = r.choice(_KEYS[kind])
        field = r.choice([f'{{"{key}": "{v}", "w": 9}}', f'{{"id": 999, "{key}": "{v}"}}', f'{key} = "{v}"', f"{key}: {v}", f"{key}={v}"]).replace("{{", "{").replace("}}}", "}}")
        clause = r.choice([f"{v} {r.choice(_SAID)} w w w.", f"w w {r.choice(_NEAR)} {v} w w.", f"{r.choice(_NEAR)} {v}", f"w the w {r.choice(_NEAR)} {v}.", f"w w. {v} {r.choice(_SAID)} the w w w.", f"{r.choice(_NEAR).title()} {v} who {r.choice(_SAID)} w w.", f"w w w. {r.choice(_NEAR).title()} {v}, w w"]) if kind == "N" else f"w w {v}, w w."
        role = f"{r.choice(_ROLES)}: {r.choice(['', '', 'Dr. ', 'Prof. '])}{v}" if kind == "N" else r.choice(_LEAD[kind])
        text = r.choices([r.choice(_LEAD[kind]), clause, role, field], [4, 2 if kind in "N" else 0.3, 2, 1])[0]
        if kind == "N" and r.random() < 0.15 and ". " + v not in text:
            text = text.replace(v, r.choice(["Dr. ", "Dr. ", "Prof. ", "Mr. ", "Mrs. ", "Ms. "]) + v)
        return r.choice(["", "", "", "w w w. ", "w w.\n", "w w w.\n\n"]) + text

    def fill(self, kind: str) -> str:
        r, w, t = self.r, self.word, lambda: self.word(True)
        if kind == "N":
            return r.choice([f"{t()} {t()}"] * 4 + [f"{t()} {r.choice('ABCDEFGH')}. {t()}", f"{t()}, {t()}", f"{t()}, {t()}", f"{t()}-{t()} {t()}", f"{t()} O'{t()}", f"{t()} {r.choice(['von', 'van', 'de', 'da', 'del'])} {t()}"])
        if kind == "E":
            local, host = r.choice([w(), f"{w()}_{w()[0]}", f"{w()}.{w()}", f"{w()}+{w()}", w() + self.digits("99")]), r.choice([f"{w()}.example", f"{w()}.{w()}.test", f"{w()}.invalid", f"{w()}.com"])
            out = r.choice([f"{local}@{host}"] * 3 + [f"{local}(at){host}", f"{local} at {host.replace('.', ' dot ')}", f"{local}[at]{host}"])
            return out.upper() if r.random() < 0.08 and "@" in out else out
        if kind == "P":
            return self.digits(r.choice(["+99 99 99999 999", "+99 99 9999 9999", "+9 999 555 0199", "tel:+9-999-555-0199", "(999) 555-0199", "999.0199.9999", "0099-99-99999999", "0099-99-99999999", "+99 9 99 99 99 99", "+99-999-9999999", "999-555-0199", "0999 9999999"]))
        if kind == "I":
            return self.letters(r.choice(["SSN 999-99-9999", "tax id 99999999999", "driving licence D999-9999-9999", "passport no. X9999999", "national id 99999999R", "NI number QQ 99 99 99 C", "social insurance number 99 999999 B 999", "passport C9999999", "national id X9999999L", "driver license D9999999", "tax number 99/999/99999", "SSN: 999-99-9999", "identity number 999999-9999", "ssn 999-99-9999", "ssn is 999-99-9999", "passport number XX9999999", "Passport number X9999999", "Passport XX999999", "licence number X9999999", "national id 999 999 999", "Steuernummer 99/999/99999", "DNI 99999999X", "insurance no. XX 99 99 99 X"]))
        n, place = r.randint(1, 240), r.choice([t(), f"{t()} {t()}", f"Port {t()}", f"Sankt {t()}", f"{t()} {t()} {t()}"])
        street = r.choice([f"{n} {t()} {r.choice(['Road', 'Street', 'Lane', 'Ave.', 'Avenue', 'Rd', 'St.', 'Drive'])}", f"Calle {t()} {n}", f"{n} rue de la {t()}", f"{n} rue {t()}", f"{t()}strasse {n}", f"{t()}straße {n}", f"{t()}{r.choice(['gasse', 'platz', 'allee'])} {n}", f"{n} {t()} {r.choice(['Row', 'Court', 'Place', 'Square', 'Boulevard', 'Way'])}", f"Avenida {t()} {n}", f"Flat {r.randint(1, 30)}, {n} {t()} {r.choice(['Road', 'Rd', 'Lane'])}", f"{t()}weg {n}"])
        return street + ", " + (self.digits("99999 ") if re.search("stra(?:ss|ß)e|weg|gasse|platz|allee", street) and r.random() < 0.8 else "") + place

    def outside(self, s: str) -> str:
        s = re.sub(r"\bw\b", lambda _: self.word(), s)
        s = s.replace("x_x", f"{self.word()}_{self.word()}").replace("FooBarBaz", self.word(True) + self.word(True) + self.word(True))
        s = re.sub(r"\bFoo\b|\bTool\b", lambda _: self.word(True), re.sub(r"\bBar\b", lambda _: self.word(True), s))
        s = re.sub(r"\bfoo\b|\bbar\b", lambda _: self.word(), s)
        return self.digits(s)

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for k in range(self.r.choice([1, 1, 2, 2, 3])):
            text += self.r.choice([" ", " ", "\n"]) if k else ""
            if self.r.random() < 0.42:
                text += self.outside(self.r.choice(_WITHOUT))
                continue
            kind = self.r.choice("NEPIA")
            head, tail = self.frame(kind).split("{" + kind + "}")
            text += self.outside(head)
            value = self.fill(kind)
            spans.append((len(text), len(text) + len(value), dict(zip("EPIAN", TYPES))[kind]))
            text += value + self.outside(tail)
        return text, spans


def windows(text: str) -> list[list[tuple[int, int, str, str]]]:
    """Token windows around candidates, in order, not overlapping."""
    found = sorted(m.span() for p in _CANDIDATES for m in p.finditer(text))
    if not found:
        return []
    # Only the neighbourhood of candidates is tokenised: enough characters for SIDE tokens, from a token's edge.
    areas: list[list[int]] = []
    for a, b in found:
        lo, hi = text.rfind(" ", 0, max(0, a - 90)) + 1, b + 90
        if areas and lo <= areas[-1][1]:
            areas[-1][1] = max(areas[-1][1], hi)
            areas[-1][2].append((a, b))
        else:
            areas.append([lo, hi, [(a, b)]])
    out = []
    for lo, hi, spans in areas:
        if hi < len(text):
            nxt = text.find(" ", hi)
            hi = min(nxt if nxt >= 0 else len(text), hi + 60)
        toks = [(s + lo, e + lo, k, a) for s, e, k, a in tokens(text[lo:hi])]
        keep = np.zeros(len(toks), bool)
        j = 0
        for a, b in spans:  # in order of their starts
            while j < len(toks) and toks[j][1] <= a:
                j += 1
            k = j
            while k < len(toks) and toks[k][0] < b:
                k += 1
            keep[max(0, j - SIDE) : k + SIDE] = True
        i = 0
        while i < len(toks):
            if keep[i]:
                j = i
                while j < len(toks) and keep[j]:
                    j += 1
                out.append(toks[i:j])
                i = j
            else:
                i += 1
    return out


def _gaps(window: list[tuple[int, int, str, str]]) -> list[bool]:
    return [i > 0 and window[i][0] > window[i - 1][1] for i in range(len(window))]


@functools.lru_cache(maxsize=4)
def fit_model(sentences: int = SENTENCES, seed: int = 11) -> ChainCRF:
    """The field's weights, from ``sentences`` generated texts; fitted once a process. ``skip`` is the learned reward of a skip edge."""
    writer, crf, data = _Writer(seed), ChainCRF(TYPES), []
    at = {x: i for i, x in enumerate(crf.labels)}
    for _ in range(sentences):
        text, spans = writer.sentence()
        for window in windows(text):
            y = []
            for s, e, _, _a in window:
                inside = next(((a, b, k) for a, b, k in spans if a <= s and e <= b), None)
                if inside is None:
                    y.append(0)
                else:
                    first = not y or crf.labels[y[-1]][2:] != inside[2] or not any(inside[0] <= w[0] < s for w in window)
                    y.append(at[("B-" if first else "I-") + inside[2]])
            data.append((_features([w[3] for w in window], _gaps(window)), y))
    crf.fit(data)
    crf.skip = fit_skip(crf, writer, max(40, sentences // 12))
    return crf


def fit_skip(crf: ChainCRF, writer: _Writer, texts: int) -> float:
    """The reward of a skip edge under which most spans come out right in texts that repeat a name, or another capitalised
    phrase, once in a clear context and then in ones that tell nothing; the least of equals."""
    docs = []
    weak = ["w w V w w.", "V w w w.", "w V", "w, V, w w", "w w w V."]
    for k in range(texts):
        named = bool(k % 3)
        value = writer.fill("N").replace(",", "") if named else writer.word(True) + " " + writer.word(True)
        clear = writer.frame("N").replace("{N}", "V") if named else writer.r.choice(["The V service w w.", "the V release w", "w the V team w it.", "The V Tool w 9 w.", "V Guide, Table 9"])
        text, spans = "", []
        for frame in [clear, writer.r.choice(weak), writer.r.choice(weak)]:
            head, tail = frame.split("V", 1)
            text += writer.outside(head)
            if named:
                spans.append((len(text), len(text) + len(value), "person_name"))
            text += value + writer.outside(tail) + writer.r.choice([" ", "\n"])
        docs.append((text, set(spans)))
    best = []
    for strength in SKIPS:
        crf.skip = strength
        finder = Finder(crf)
        best.append((sum(len(set(finder.find(t)) ^ want) for t, want in docs), strength))
    return min(best)[1]


_DIGITS = re.compile(r"\d")
# The least and most digits of a phone number.
_MIN_PHONE, _MAX_PHONE = 7, 15


def _plausible(kind: str, value: str) -> bool:
    """The exact check behind the field: what a value of the type must at least look like."""
    if kind == "email":
        return bool(re.search(r"@|\(at\)|\[at\]| at ", value)) and not re.match(r"(?i)(?:mailto:)?git@", value)
    if kind == "phone":
        return _MIN_PHONE <= len(_DIGITS.findall(value)) <= _MAX_PHONE
    if kind == "id_number":
        return len(_DIGITS.findall(value)) >= 5
    if kind == "street_address":
        return bool(_DIGITS.search(value)) and bool(re.search(rf"{_T}", value)) and "," in value
    return bool(re.fullmatch(rf"(?:(?:Dr|Mr|Mrs|Ms|Prof)\.? )?{_T}(?:,)?(?: (?:[A-Z]\.?|von|van|de|da|del|la|bin|al))*(?: {_T})+", value.strip()))


class Finder:
    """Finds spans in texts with a fitted field and a cache of decoded windows."""

    def __init__(self, crf: ChainCRF):
        self.crf = crf
        self.cache: dict[tuple, list[int]] = {}

    def _emissions(self, window) -> np.ndarray:
        return self.crf.emissions(_features([w[3] for w in window], _gaps(window)))

    def find(self, text: str) -> list[tuple[int, int, str]]:
        wins = windows(text)
        if not wins:
            return []
        labels = []
        seen: dict[str, list[tuple[int, int]]] = {}
        for c, w in enumerate(wins):
            key = (tuple(t[3] for t in w), tuple(_gaps(w)))
            y = self.cache.get(key)
            if y is None:
                if len(self.cache) >= _CACHE_MAX:
                    self.cache.clear()
                y = self.cache[key] = self.crf.viterbi(self._emissions(w))
            labels.append(y)
            for t, (s, e, kind, a) in enumerate(w):
                if a == "T":
                    seen.setdefault(text[s:e], []).append((c, t))
        # Skip edges between neighbouring occurrences of a word that is an entity somewhere and not everywhere.
        edges = []
        for places in seen.values():
            if len(places) > 1 and len({labels[c][t] == 0 for c, t in places}) == 2:
                edges += list(zip(places, places[1:]))
        if edges:
            used = sorted({c for e in edges for c, _ in e})
            at = {c: i for i, c in enumerate(used)}
            again = self.crf.skip_decode([self._emissions(wins[c]) for c in used], [((at[a[0]], a[1]), (at[b[0]], b[1])) for a, b in edges], self.crf.skip)
            for c in used:
                labels[c] = again[at[c]]
        out = []
        for w, y in zip(wins, labels):
            for a, b, kind in self.crf.spans(y):
                s, e = w[a][0], w[b - 1][1]
                if _plausible(kind, text[s:e]):
                    out.append((s, e, kind))
        return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its type in brackets."""
    parts, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join(parts) + text[at:]


# --- Over tables ---


def history_texts(text: str | None) -> list[tuple[int, str]]:
    """Positions and texts of a history, if it is a valid JSON list; lists of parts are joined by line ends."""
    try:
        items = json.loads(text or "")
    except (ValueError, RecursionError):
        return []
    out = []
    for i, m in enumerate(items if isinstance(items, list) else []):
        c = m.get("content") if isinstance(m, dict) else None
        if isinstance(c, list):
            c = "\n".join(p if isinstance(p, str) else str(p.get("text") or "") for p in c if isinstance(p, (str, dict)))
        if isinstance(c, str) and c:
            out.append((i, c))
    return out


_LAST: list[tuple[tuple, Finder]] = []


def _finder(packed: tuple) -> Finder:
    """The worker's finder for these weights; only the last one is kept."""
    if not _LAST or _LAST[0][0] is not packed:
        crf = ChainCRF(TYPES)
        crf.W, crf.A, crf.skip = packed
        _LAST[:] = [(packed, Finder(crf))]
    return _LAST[0][1]


def find_personal_data(messages: DataFrame, sessions: DataFrame, records: DataFrame, *, with_text: bool = False, sentences: int = SENTENCES) -> DataFrame:
    """``(record_kind, record_id, msg_pos, pii_types[, redacted])`` of every message that holds personal data.

    Null, empty and blank texts, null ids, histories that are no JSON list and messages without text give nothing;
    repeated rows give repeated rows here. ``redacted`` is the whole text with typed placeholders.
    """
    spark = messages.sparkSession
    crf = fit_model(sentences)
    model = spark.sparkContext.broadcast((crf.W, crf.A, crf.skip))
    schema = "record_kind string, record_id string, msg_pos int, pii_types array<string>" + (", redacted string" if with_text else "")

    def run(kind: str, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(model.value)
        for batch in it:
            ids, pos, types, texts = [], [], [], []
            places = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if i is None or not t:
                    continue
                for p, s in history_texts(t) if kind == "chat_record" else [(places[k] if places else 0, t)]:
                    if spans := finder.find(s):
                        ids.append(i)
                        pos.append(p)
                        types.append(sorted({x[2] for x in spans}))
                        if with_text:
                            texts.append(redact(s, spans))
            cols = [pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(pos, pa.int32()), pa.array(types, pa.list_(pa.string()))]
            names = ["record_kind", "record_id", "msg_pos", "pii_types"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    turns = sessions.select(F.col("session_id").cast("string").alias("id"), F.posexplode("messages").alias("pos", "m")).select("id", F.col("m.content").alias("t"), "pos").where("t <> ''")
    parts = [
        messages.select(F.col("msg_id").cast("string").alias("id"), F.col("content").alias("t")).where("t <> ''").mapInArrow(lambda it: run("message", it), schema),
        turns.mapInArrow(lambda it: run("session", it), schema),
        records.select(F.col("request_id").cast("string").alias("id"), F.col("full_history").alias("t")).where("t <> ''").mapInArrow(lambda it: run("chat_record", it), schema),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
