"""Personal data under format-preserving pseudonyms: keyed permutations inside each format."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The key decides the pseudonyms; a real run gives its own by this setting of the session.
KEY_SETTING = "mixledger.pii.key"
DEFAULT_KEY = "change me"
ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1), 73049  # to the end of 2099

# ------------------------------------------------------------------------------------- Feistel


def _mix(key: bytes, tweak: str, turn: int, value: int, modulus: int) -> int:
    """A keyed number below ``modulus`` for one round."""
    size = (modulus.bit_length() + 7) // 8 + 8
    data = f"{tweak}|{turn}|{value}".encode()
    stream = b""
    while len(stream) < size:
        stream += hashlib.blake2b(data + bytes([len(stream) & 255]), key=key, digest_size=64).digest()
    return int.from_bytes(stream[:size], "big") % modulus


def permute(key: bytes, tweak: str, value: int, a: int, b: int) -> int:
    """A keyed permutation of 0 .. a * b - 1: Feistel rounds that add modulo a and modulo b in turn.

    Each round adds to one half a number that the other half decides, so it can be undone, whatever a
    and b are; no value leaves the domain.
    """
    left, right = divmod(value, b)
    for turn in range(ROUNDS):
        if turn % 2:
            right = (right + _mix(key, tweak, turn, left, b)) % b
        else:
            left = (left + _mix(key, tweak, turn, right, a)) % a
    return left * b + right


_LOWER_LATIN = [chr(c) for c in range(0xE0, 0x100) if c != 0xF7]
_CLASSES = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(_LOWER_LATIN),
    "".join(c.upper() for c in _LOWER_LATIN if c.upper() != c and len(c.upper()) == 1 and ord(c.upper()) < 256),
]
_CLASS_OF = {c: letters for letters in _CLASSES for c in letters}


def permute_text(key: bytes, kind: str, text: str) -> str:
    """A string of the same format: every digit and letter gives way to one of its own class."""
    at = [i for i, c in enumerate(text) if c in _CLASS_OF]
    if not at:
        return text
    value, sizes = 0, [len(_CLASS_OF[text[i]]) for i in at]
    for i, size in zip(at, sizes):
        value = value * size + _CLASS_OF[text[i]].index(text[i])
    b = 1
    for size in sizes[len(sizes) // 2 :]:
        b *= size
    a = 1
    for size in sizes[: len(sizes) // 2]:
        a *= size
    shape = "".join("?" if c in _CLASS_OF else c for c in text)
    tweak = f"{kind}|{shape}|{'.'.join(map(str, sizes))}"
    value = permute(key, tweak, value, a, b)
    out = list(text)
    for i, size in zip(reversed(at), reversed(sizes)):
        value, digit = divmod(value, size)
        out[i] = _CLASS_OF[text[i]][digit]
    return "".join(out)


def put_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in text)


# ------------------------------------------------------------------------- formats, each checked


def luhn(digits: str) -> int:
    """The sum that is divisible by 10 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total


def _card(key: bytes, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = permute_text(key, "card", digits[:-1])
    return put_digits(m[0], body + str(-luhn(body + "0") % 10))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, m: re.Match) -> str | None:
    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = permute_text(key, "iban", plain[4:])
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    rest = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in m[0])


def _social(key: bytes, m: re.Match) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permute(key, "social", value, 898 * 99, 9999), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _address(key: bytes, m: re.Match) -> str | None:
    parts = [int(p) for p in m[0].split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in m[0].split(".")):
        return None
    value = permute(key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _mail(key: bytes, m: re.Match) -> str | None:
    # The name is private and is permuted; the host stays, as it is shared by many.
    return permute_text(key, "mail", m[1]) + "@" + m[2]


def _phone(key: bytes, m: re.Match) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 9 <= len(digits) <= 15:
        return None
    head = len(re.sub(r"\D", "", m[1] or ""))  # the country code stays
    return put_digits(m[0], digits[:head] + permute_text(key, f"phone{digits[:head]}", digits[head:]))


def permute_day(key: bytes, day: dt.date) -> dt.date | None:
    value = (day - FIRST_DAY).days
    if not 0 <= value < DAYS:
        return None
    while True:  # 271 * 270 is little more than the days, so a second step is rare
        value = permute(key, "day", value, 271, 270)
        if value < DAYS:
            return FIRST_DAY + dt.timedelta(value)


def _date(order: str) -> Callable[[bytes, re.Match], str | None]:
    def run(key: bytes, m: re.Match) -> str | None:
        parts = {k: int(v) for k, v in zip(order, (m[1], m[3], m[4]))}
        try:
            day = permute_day(key, dt.date(parts["y"], parts["m"], parts["d"]))
        except ValueError:
            return None
        if day is None:
            return None
        new = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return m[2].join(new[k] for k in order)

    return run


def _secret(key: bytes, m: re.Match) -> str | None:
    if not (re.search(r"\d", m[2]) and re.search(r"[A-Za-z]", m[2])):
        return None
    return m[1] + _hex_text(key, m[2]) if re.fullmatch(r"[0-9a-f]+", m[2]) else m[1] + permute_text(key, "secret", m[2])


def _hex_text(key: bytes, text: str) -> str:
    half = len(text) // 2
    value = permute(key, f"hex{len(text)}", int(text, 16), 16**half, 16 ** (len(text) - half))
    return f"{value:0{len(text)}x}"


#: (kind, pattern, what makes a pseudonym or finds the match invalid). Earlier ones take a match first.
FORMATS: list[tuple[str, re.Pattern, Callable[[bytes, re.Match], str | None]]] = [
    ("mail", re.compile(r"(?<![\w.+-])([\w.+-]+)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), _mail),
    ("secret", re.compile(r"((?:token|secret|password|passwd|api_?key|key)\s*[=:]\s*[\"']?)([A-Za-z0-9_\-/+]{16,})", re.I), _secret),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _iban),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), _card),
    ("social", re.compile(r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])"), _social),
    ("date", re.compile(r"(?<![\w./-])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?![\w/-])"), _date("ymd")),
    ("date", re.compile(r"(?<![\w./-])(\d{1,2})([.-])(\d{1,2})\2(\d{4})(?![\w/-])"), _date("dmy")),
    ("date", re.compile(r"(?<![\w./-])(\d{1,2})(/)(\d{1,2})/(\d{4})(?![\w/-])"), _date("mdy")),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _address),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3})[ .-]?(?:\(\d{1,4}\)|\d)(?:[ .-]?\d){5,12}(?!\w)"), _phone),
    ("phone", re.compile(r"(?<![\w+.-])()(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-])"), _phone),
]
KINDS = list(dict.fromkeys(kind for kind, _, _ in FORMATS))
#: Kinds whose match can take in neighbours, with the pattern for a part of such a match.
_PARTS = {"iban": FORMATS[2][1], "card": re.compile(r"\d(?:[ -]?\d){12,18}(?![\w-])")}
_BORDER = re.compile(r"[ -]")
_ANY = re.compile(r"[0-9@=:]")


def _readings(kind: str, m: re.Match) -> Iterator[re.Match]:
    """The match, its shorter prefixes that end at a group border, then the same from every later border.

    A greedy match takes in groups before or behind the value (a security code, an expiry, a year), which
    fails its check. Parts of a card number are read only in groups of three digits or more, as cards are
    printed, so dates in a row are not cut up.
    """
    yield m
    if kind not in _PARTS:
        return
    text, part = m.string, _PARTS[kind]
    borders = [m.start() + b.start() for b in _BORDER.finditer(m[0])]
    for start in [m.start(), *[b + 1 for b in borders]]:
        longest = m if start == m.start() else part.match(text, start)
        if longest is None:
            continue
        ends = [b.start() for b in _BORDER.finditer(text, start, longest.end())]
        for end in [*([longest.end()] if longest is not m else []), *reversed(ends)]:
            found = part.fullmatch(text, start, end)
            if found and (kind != "card" or min(map(len, _BORDER.split(found[0]))) >= 3):
                yield found


def pseudonymize(key: bytes, text: str) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not _ANY.search(text):
        return text, counts
    taken: list[tuple[int, int, str]] = []
    for kind, pattern, make in FORMATS:
        at = 0
        while m := pattern.search(text, at):
            at = m.end()
            for found in _readings(kind, m):
                if any(a < found.end() and found.start() < b for a, b, _ in taken):
                    continue
                new = make(key, found)
                if new is not None:
                    taken.append((found.start(), found.end(), new))
                    counts[kind] = counts.get(kind, 0) + 1
                    at = found.end()
                    break
    if not taken:
        return text, counts
    out, last = [], 0
    for a, b, new in sorted(taken):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), counts


def pseudonymize_documents(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and, for each kind, the number of values found.

    A value is replaced only if it passes its check (Luhn, modulus 97, calendar, number ranges).
    The same value gets the same pseudonym in every document, and two values never share one. Null
    texts stay null, empty ones empty, with counts 0. A column named like a count is replaced. No
    shuffle; all other columns and rows are as they were.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    names = [f"n_{kind}" for kind in KINDS]
    kept = [c for c in docs.columns if c not in names and c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{text_col}` string", *[f"{n} int" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for value in batch.column(len(kept)):
                text = value.as_py()
                new, counts = (None, {}) if text is None else pseudonymize(secret, text)
                texts.append(new)
                found.append(counts)
            numbers = [pa.array([c.get(kind, 0) for c in found], pa.int32()) for kind in KINDS]
            cols = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), *numbers]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, text_col, *names])

    order = [text_col if c == text_col else c for c in docs.columns if c not in names]
    out = docs.select(*kept, text_col).mapInArrow(run, schema)
    return out.select(*order, *names)


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, DEFAULT_KEY)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymize_documents(docs, key)
