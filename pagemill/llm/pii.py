"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Generators propose overlapping spans around what personal data needs (digits,
``@``, ``=``, ``:``, words such as "password" or "dot", long mixed tokens).
Each span gets features of its format and its context; boosted trees score it,
isotonic regression on held-out examples turns scores into probabilities, and
each kind's threshold is set there for its recall, where data that no
generator proposes count as missed.  Of overlapping spans that pass, the
likeliest is redacted.

Kinds: e-mail addresses (also with "at" and "dot"), phone, card, social
security and bank account numbers, IP addresses, street addresses, names after
a title, and secrets: long random tokens, and whatever follows a cue such as
"password:" or "api_key =".

The examples are generated here from fixed seeds: no corpus is needed.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, calibrated, isotonic
from .common import documents, fold, pieces, text_views, tidy

AROUND = 160
RECALL = 0.99
TRAINING = 12000

_LOCAL = re.compile(r"[\w.!%+'-]{1,64}")
_AT = re.compile(r"@[\w-]++(?:\.[\w-]++)*+")
_WORDS_AT = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+ ?[(\[]?(?<=[ (\[])at[)\]]? ?(?<=[ )\]])[\w-]{1,63}+(?: ?[(\[]?(?<=[ (\[])dot[)\]]? ?(?<=[ )\]])[\w-]{2,63}+){1,4}", re.I)
_CUE = re.compile(
    r"(?<![^\W_])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|auth|(?:api|access|private|secret|client)?[ _-]?key|mot de passe|passwort|contraseña)s?[\w-]{0,24}+"
    r"[\"']?\s{0,3}(?:[:=]|=>|is\b|ist\b|est\b|es\b)\s{0,3}[\"']?(?P<v>[^\s\"'<>]{4,}+)", re.I,
)
_TAIL = ".,;:!?)]}"


def _emails(text: str):
    for m in _AT.finditer(text):
        a = m.start()
        before = _LOCAL.match(text[max(0, a - 64) : a][::-1])
        if before:
            yield a - before.end(), m.end()
    yield from (m.span() for m in _WORDS_AT.finditer(text)) if "dot" in text or "DOT" in text else ()


def _secrets(text: str):
    for m in _TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) or any(c.isupper() for c in v[1:]):
            yield m.span()
    for m in _CUE.finditer(text):
        a, b = m.span("v")
        while b - a > 4 and text[b - 1] in _TAIL:
            b -= 1
        yield a, b


def _all(pattern: str):
    find = re.compile(pattern).finditer
    return lambda text: (m.span() for m in find(text))


# A run of token characters is tried from its start only, and runs that can be
# long are possessive: every generator takes time in proportion to the text.
_TOKEN = re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{16,}+={0,2}+(?!\w)")
GENERATORS = {
    "EMAIL": _emails,
    "PHONE": _all(r"(?<![\w.])\+?(?:\(\d{1,4}\)|\d)[\d\s().-]{5,18}\d(?!\w|[.-]\d)"),
    "CARD": _all(r"(?<!\w)\d(?:[ -]?\d){11,18}(?!\w)"),
    "IP": _all(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)|(?<![\w:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![\w:])"),
    "SECRET": _secrets,
    "SSN": _all(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "IBAN": _all(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ADDRESS": _all(
        r"(?<![\w.,-])\d{1,5}[A-Za-z]?,? (?:[A-ZÀ-Þ][\w'.-]{1,24} ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Sq|Way|Place|Terrace)\b"
        r"|(?<![\w.,-])\d{1,5},? (?:rue|avenue|boulevard|place|allée|chemin)(?: (?:de|du|des|la|le|les|[A-ZÀ-Þ][\w'-]{1,24})){1,5}"
        r"|(?<!\w)[A-ZÄÖÜ][\w-]{1,30}(?:straße|strasse|weg|allee|platz|gasse) \d{1,4}[a-z]?\b"
        r"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo)(?: (?:de|del|la|las|los|[A-ZÁÉÍÓÚÑ][\w'-]{1,24})){1,5},? \d{1,4}\b"
    ),
    "PERSON": _all(r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?)\.? (?:[A-ZÀ-Þ][\w'-]{1,24})(?: [A-ZÀ-Þ][\w'-]{1,24}){0,2}"),
}
KINDS = list(GENERATORS)
_CUES = {
    "mail": "mail email e-mail contact courriel correo contacto kontakt write reach".split(),
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono".split(),
    "card": "card visa mastercard credit karte carte tarjeta payment".split(),
    "host": "ip host server address addr login from".split(),
    "secret": "token key secret api apikey api_key auth bearer credential".split(),
    "password": "password passwd passphrase passcode pwd passwort contraseña passe".split(),
    "person": "ssn social iban account konto compte cuenta".split(),
    "other": "order invoice version commit isbn page build release serial ref sku uuid sha256 chapter".split(),
}
_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = True
_TRIGGER[[ord("@"), ord("="), ord(":")]] = True
_TRIGGER_WORDS = re.compile(
    rb"passw|passph|passco|pwd|secret|token|credential|bearer|auth|key|mot de passe|contrase|[ (\[]dot[ )\]]|\b(?:mrs?|ms|miss|dr|prof|herr|frau|mme|mlle|monsieur|madame|se\xc3\xb1ora?|sra?)\b"
)
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[48:58] = _TOKEN_BYTE[65:91] = _TOKEN_BYTE[97:123] = True
_TOKEN_BYTE[[ord(c) for c in "_/+-="]] = True


def _luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def features(text: str, start: int, stop: int, kind: int) -> list[float]:
    s = text[start:stop]
    digits = [c for c in s if c.isdigit()]
    d = "".join(digits)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    parts = s.split(".")
    counts = np.array(list(Counter(s).values()), float) / max(1, len(s))
    before = text[max(0, start - 40) : start].lower()
    words = re.findall(r"[\w-]+", before)[-3:]
    prev = text[start - 1] if start else " "
    nxt = text[stop] if stop < len(text) else " "
    domain = s.rpartition("@")[2]
    f = [
        kind, len(s), len(d), len(d) / max(1, len(s)), letters, upper / max(1, letters), hexes / max(1, len(s)),
        s.count(" "), s.count("-"), s.count("."), float("+" in s), float("(" in s), float("@" in s), float("." in domain and "@" in s),
        float(len(d) >= 12 and d.isascii() and _luhn(d)), float(len(parts) == 4 and all(p.isdigit() and int(p) < 256 for p in parts)),
        float(-(counts * np.log2(counts)).sum()), float(s[:1].isalpha()), s.count(":"), float("_" in s or "/" in s),
        float(prev in "\"'"), float(prev.isspace()), float(prev == "="), float(nxt.isspace()), float(nxt in "\"'"), float(nxt in ".,;!?)"),
        float("=" in before[-4:] or ":" in before[-3:]), float("$" in before[-2:] or "€" in before[-2:]),
        float(len(set(d)) if d else 0), float(d[:2] in ("19", "20") if d else 0),
    ]
    f += [float(any(w.strip("-") in c for w in words)) for c in _CUES.values()]
    sign = before.rstrip(" \"'")[-1:]
    f += [float(sign in (":", "=")), float(any(p in before[-28:] for p in ("passw", "passphr", "passcode", "pwd", "contraseña", "mot de passe"))), float(s.isalpha() and s.islower()), float(any(not c.isalnum() for c in s))]
    case = [c.isupper() for c in s]
    f += [sum(a != b for a, b in zip(case, case[1:])) / max(1, len(s)), sum(c in "aeiouAEIOU" for c in s) / max(1, letters)]
    return f


def candidates(text: str) -> list[tuple[int, int, int]]:
    """All generators' spans: (start, stop, kind), overlapping ones too."""
    return [(a, b, k) for k, f in enumerate(GENERATORS.values()) for a, b in f(text)]


# ---------------------------------------------------------------- examples


def _examples(n: int, seed: int) -> tuple[list[list[float]], list[int], list[int], list[int]]:
    """Generated sentences with personal data or look-alikes, as candidates:
    (features, is it one, kinds); and how often data of each kind were proposed
    by no generator."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ea", "ti", "es", "or", "la", "de", "que", "ung", "ción", "é", "ä"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))

    def email():
        return r.choice([word() + "." + digits(2), word() + digits(r.randint(0, 3)), word() + "." + word(), word() + "_" + word()]) + "@" + r.choice(["mail" + digits(1), word(), word() + "-" + word()]) + "." + r.choice(["com", "org", "net", "example.com", "co.uk", "de", "fr"])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(2)} {digits(9)}", f"{a}.{b}.{c}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"])

    def card():
        d = r.choice(["4", "5", "37", "6011"])
        d += digits(15 - len(d)) if not d.startswith("37") else digits(12)
        d += next(c for c in "0123456789" if _luhn(d + c)) if r.random() < 0.5 else digits(1)
        return r.choice([d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4)), digits(16)])

    def ip():
        return ".".join(str(r.randint(0, 255)) for _ in range(4)) if r.random() < 0.85 else ":".join(hexes(r.randint(1, 4)) for _ in range(8))

    letters = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    name = lambda: (word() + word()).capitalize()[:12]

    def secret():
        v = r.choice([hexes(40), hexes(32), mixed(r.randint(20, 44)), letters(r.randint(20, 40)), "sk-" + mixed(32), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36)])
        return f'{r.choice(["token", "api_key", "secret", "password", "key"])} {r.choice(["=", ":"])} "{v}"' if r.random() < 0.8 else v

    def password():
        v = r.choice([word() + digits(r.randint(1, 4)), name() + r.choice("!$&#*") + digits(2), mixed(r.randint(6, 15)), word() + "-" + word() + "-" + word(), word() + word(), "Tr0ub" + mixed(3) + "&" + digits(1)])
        cue = r.choice(["password", "Password", "passwd", "pwd", "passphrase", "passcode", "user_password", "mot de passe", "Passwort", "contraseña"])
        return f'{cue}{r.choice([" = ", ": ", "=", ":", " is "])}{r.choice(["", "", chr(34)])}<{v}>'

    def short_key():
        v = r.choice([mixed(r.randint(8, 15)), hexes(12), word() + digits(4), digits(6) + word()])
        return f'{r.choice(["api_key", "token", "secret", "access key", "auth_token", "client_secret"])}{r.choice([" = ", ": ", "="])}<{v}>'

    def spelt():
        return f"{word()}{r.choice(['', '.' + word()])} at {word()}{word()} dot {r.choice(['com', 'org', 'net', 'de'])}"

    def address():
        n = r.choice([digits(1), digits(2), digits(3)])
        return r.choice([f"{n} {name()} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'St', 'Ave'])}", f"{n} rue de la {name()}", f"{name()}straße {n}", f"Calle {name()}, {n}", f"{n} {name()} {name()} Road"])

    def person():
        return f"{r.choice(['Mr', 'Mrs', 'Ms', 'Dr', 'Mr.', 'Dr.', 'Herr', 'Frau', 'Mme', 'Sra', 'Prof.'])} {name()}{r.choice(['', ' ' + name()])}"

    def iban():
        return r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + r.choice([digits(18), " " + " ".join(digits(4) for _ in range(4)) + " " + digits(2)])

    def ssn():
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    positive = [email, email, phone, phone, card, card, ip, ip, secret, secret, iban, ssn, password, password, short_key, spelt, address, person]
    negative = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1990, 2030)}", lambda: f"version {r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 999)}",
        lambda: f"build {r.randint(256, 999)}.{r.randint(0, 999)}.{r.randint(300, 999)}.{r.randint(0, 999)}",
        lambda: "commit " + hexes(40), lambda: "sha256 " + hexes(64), lambda: f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"order {digits(r.randint(6, 10))}", lambda: f"${digits(2)},{digits(3)}.{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)} {word()}",
        lambda: f"{digits(2)}.{digits(5)} {digits(2)}.{digits(5)}", lambda: f"x = {digits(2)}", lambda: f"{word()}@ {word()}", lambda: f"@{word()}{digits(2)}",
        lambda: word() + word() + word() + word() + digits(2), lambda: f"{digits(1)} {digits(1)} {digits(2)} {digits(1)} {digits(2)} {digits(3)}",
        lambda: f"pages {digits(3)}-{digits(3)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{r.choice(['key', 'token', 'secret', 'the key', 'auth', 'bearer'])} {r.choice(['is', ':'])} {word()}", lambda: f"{word()} at {word()} {word()} dot {word()}", lambda: f"{word()}: {word()}", lambda: name() + name() + name() + name(), lambda: name() + word().capitalize() + name() + word().capitalize() + r.choice(['', digits(1), digits(2)]), lambda: (word() + '_' + word() + '_' + word()).upper() + r.choice(['', '_' + digits(1)]), lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}",
        lambda: f"{digits(2)} {name()} {name()} {word()}", lambda: f"{name()} {word()} {name()}", lambda: f"{digits(2)}:{digits(2)} {word()} {name()}", lambda: f"https://{word()}.org/{word()}/{word()}/{name()}{digits(2)}",
        lambda: "uuid " + "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1900, 2030)} {digits(4)} {digits(4)}",
    ]
    kind_of = {email: "EMAIL", phone: "PHONE", card: "CARD", ip: "IP", secret: "SECRET", iban: "IBAN", ssn: "SSN", password: "SECRET", short_key: "SECRET", spelt: "EMAIL", address: "ADDRESS", person: "PERSON"}
    cue = {email: "mail", phone: "phone", card: "card", ip: "host", iban: "person", ssn: "person", spelt: "mail"}
    x, y, kinds, missed = [], [], [], [0] * len(KINDS)
    while len(x) < n:
        wrap = r.choice([("", ""), ("", ""), ("", r.choice(["***", "###", "$$$", "%%%", "&&&"])), ("", r.choice(".,;!")), ("| ", " |"), ("(", ")")])
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        tail = " ".join(word() for _ in range(r.randint(0, 5)))
        if r.random() < 0.55:
            make = r.choice(positive)
            body, truth = make(), kind_of[make]
            if make in cue and r.random() < 0.3:
                lead += " " + r.choice(_CUES[cue[make]]) + r.choice(["", ":"])
        else:
            body, truth = r.choice(negative)(), None
        inner = re.search(r"<(.+)>", body)  # where the data themselves are
        if inner:
            body = body.replace("<", "").replace(">", "") + (chr(34) if chr(34) in body else "")
        text = f"{lead} {wrap[0]}{body}{wrap[1]} {tail}".strip()
        at = text.index(body)
        lo, hi = (at, at + len(body))
        if inner:
            lo, hi = at + inner.start(1) - 1, at + inner.end(1) - 1
        elif truth == "SECRET" and (inner := re.search(r'"([^"]+)"', body)):
            lo, hi = at + inner.start(1), at + inner.end(1)
        proposed = False
        for a, b, k in candidates(text):
            hit = truth is not None and KINDS[k] == truth and a <= lo and b >= hi and (b - a) - (hi - lo) <= 4
            x.append(features(text, a, b, k))
            y.append(int(hit))
            kinds.append(k)
            proposed |= hit
        if truth is not None and not proposed:
            missed[KINDS.index(truth)] += 1
    return x, y, kinds, missed


class Detector:
    """Trees, calibration and a threshold for each kind: the highest, at most
    one half, that finds ``recall`` of the held-out examples, those that no
    generator proposes among the lost ones; ``recall_of`` is what it finds."""

    def __init__(self, recall: float = RECALL, training: int = TRAINING):
        x, y, *_ = _examples(training, 5)
        self.trees = Boosted().fit(np.array(x), np.array(y, float))
        x, y, kind, missed = (np.array(v) for v in _examples(training // 2, 6))
        raw = self.trees.raw(x.astype(float))
        self.steps = isotonic(raw, y)
        p = calibrated(raw, self.steps)
        self.least = np.full(len(KINDS), 0.5)
        self.recall_of = np.zeros(len(KINDS))
        for k in range(len(KINDS)):
            good = np.sort(p[(kind == k) & (y == 1)])
            total = len(good) + missed[k]
            if len(good):
                lost = max(0, int((1 - recall) * total) - int(missed[k]))
                self.least[k] = min(0.5, good[lost])
                self.recall_of[k] = (good >= self.least[k]).sum() / total

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Per text, the chosen spans in order; none overlap."""
        found = [candidates(t) for t in texts]
        rows = [features(t, *c) for t, cs in zip(texts, found) for c in cs]
        raw = self.trees.raw(np.array(rows)) if rows else np.zeros(0)
        p = calibrated(raw, self.steps) if rows else raw
        out, at = [], 0
        for cs in found:
            ranked = [(q, c) for _, q, c in sorted(zip(raw[at : at + len(cs)].tolist(), p[at : at + len(cs)].tolist(), cs), key=lambda v: (-v[0], v[2][0] - v[2][1], v[2]))]
            at += len(cs)
            taken: list[tuple[int, int, str, float]] = []
            for q, (a, b, k) in ranked:
                i = bisect_left(taken, (a,))
                if q >= self.least[k] and (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                    insort(taken, (a, b, KINDS[k], q))
            out.append(taken)
        return out


@lru_cache(maxsize=2)
def detector(recall: float = RECALL, training: int = TRAINING) -> Detector:
    return Detector(recall, training)


def _triggers(buf: np.ndarray) -> np.ndarray:
    """Places that personal data may be at: signs, cue words, long tokens that
    have a digit or an upper-case letter inside."""
    on = _TRIGGER[buf]
    on[[m.start() for m in _TRIGGER_WORDS.finditer(fold(buf).tobytes())]] = True
    token = np.zeros(len(buf) + 2, np.int8)
    token[1:-1] = _TOKEN_BYTE[buf]
    turn = np.flatnonzero(np.diff(token))
    start, stop = turn[::2], turn[1::2]
    long = stop - start >= 16
    start, stop = start[long], stop[long]
    if len(start):
        mixed = np.concatenate([[0], np.cumsum(((buf >= 48) & (buf < 58)) | ((buf >= 65) & (buf < 91)))])
        keep = mixed[stop] > mixed[start + 1]
        on[start[keep]] = on[stop[keep] - 1] = True
    return np.flatnonzero(on)


def _regions(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges around triggers, cut at their text's ends: (text, start, stop)."""
    at = _triggers(buf)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    doc = np.searchsorted(off, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 2 * AROUND) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    b = np.concatenate([a[1:], [len(at)]]) - 1
    d = doc[a]
    return d, np.maximum(at[a] - AROUND, off[d]), np.minimum(at[b] + AROUND + 1, off[d + 1])


def redact_batch(col: pa.Array, det: Detector) -> tuple[list[str | None], list[list[dict]]]:
    """Redacted texts, None where nothing was found, and the spans found."""
    buf, off, _ = text_views(col)
    n = len(off) - 1
    texts: list[str | None] = [None] * n
    spans: list[list[dict]] = [[] for _ in range(n)]
    for lo, hi in pieces(off):
        part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        d, a, b = _regions(part, o)
        if not len(d):
            continue
        # whole words: widen to the next white space, at most to the text's ends
        white = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        k = np.searchsorted(white, a, "right") - 1
        left = np.where(k >= 0, white[np.maximum(k, 0)] if len(white) else 0, 0)
        a = np.maximum(np.where(k >= 0, left, 0), o[d])
        k = np.searchsorted(white, b, "left")
        right = np.where(k < len(white), white[np.minimum(k, len(white) - 1)] if len(white) else 0, len(part))
        b = np.minimum(np.where(k < len(white), right, len(part)), o[d + 1])
        data = part.tobytes()
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        # regions that came to touch are one
        merged: list[list[int]] = []
        for t, x, y in zip(d.tolist(), a.tolist(), b.tolist()):
            if merged and merged[-1][0] == t and x <= merged[-1][2]:
                merged[-1][2] = max(y, merged[-1][2])
            else:
                merged.append([t, x, y])
        views = [data[x:y].decode() for _, x, y in merged]
        per: dict[int, list] = {}
        for (t, x, _), view, got in zip(merged, views, det.spans(views)):
            if got:
                base = int(chars[x] - chars[o[t]])
                per.setdefault(t, []).extend((base + s, base + e, kind, q) for s, e, kind, q in got)
        for t, got in per.items():
            text = data[o[t] : o[t + 1]].decode()
            parts, last = [], 0
            for s, e, kind, q in got:
                parts += [text[last:s], f"[{kind}]"]
                last = e
                spans[lo + t].append({"start": s, "stop": e, "kind": kind, "score": q})
            texts[lo + t] = "".join([*parts, text[last:]])
    return texts, spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
SPANS_TYPE = "array<struct<start:int,stop:int,kind:string,score:double>>"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``(doc_id, text, spans)`` for every row: the redacted text and its spans.

    Spans are character offsets in the text as it was; each is replaced by its
    kind in brackets.  A null text stays null and has no spans; a text without
    personal data stays as it is, as does an empty one; a null id stays null;
    repeated rows are each redacted; an empty table gives an empty one.  Texts
    are searched whole, in time in proportion to their length.  Other columns
    are ignored.
    """
    det = docs.sparkSession.sparkContext.broadcast(detector(recall))

    def run(batches):
        for batch in batches:
            col = batch.column("text")
            texts, spans = redact_batch(col, det.value)
            if any(t is not None for t in texts):
                col = pa.array([o if t is None else t for o, t in zip(col.to_pylist(), texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), col, pa.array(spans, _SPANS)], names=["doc_id", "text", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id long, text string, spans {SPANS_TYPE}")


def redacted_rows(docs: DataFrame, text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``docs`` with the redacted text in place of ``text_col``; all other
    columns and all rows stay as they are."""
    det = docs.sparkSession.sparkContext.broadcast(detector(recall))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            col = batch.column(at)
            texts, _ = redact_batch(col, det.value)
            if any(t is not None for t in texts):
                col = pa.array([o if t is None else t for o, t in zip(col.to_pylist(), texts)], pa.string())
            yield batch.set_column(at, batch.schema.field(at), col)

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their redacted texts and the spans that were redacted."""
    return redact(documents(spark, sf_dir))


QUERIES = {"op5_pii_redaction": op5_pii_redaction}
