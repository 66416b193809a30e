"""Personal data replaced by pseudonyms of the same format, with a keyed Feistel permutation."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

ROUNDS = 8
KINDS = ["email", "secret", "credential", "iban", "card", "phone", "ssn", "ipv4", "ipv6", "date"]

#: Setting that has the key, as text; without it, and without a parameter, each run makes its own.
KEY_SETTING = "spark.daytrace.pii.key"


def permute(value: int, size: int, key: bytes, tweak: str, within: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked until it is in
    range again, and, if ``value`` is one of those that ``within`` accepts, among those. Equal values and tweaks always
    give equal results."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for n in range(ROUNDS):
            data = tweak.encode() + bytes([0, n]) + right.to_bytes(width, "big")
            out = hashlib.blake2b(data, key=key, digest_size=min(64, width + 8)).digest()
            left, right = right, left ^ (int.from_bytes(out, "big") & mask)
        value = left << half | right
        if value < size and (within is None or within(value)):
            return value


def _by_class(text: str, classes: list[str], key: bytes, tweak: str, within: Callable[[str], bool] | None = None) -> str:
    """Permute the characters that are in a class, each within its own; the others stay where they are. With ``within``,
    texts that it accepts, as it does ``text``, are permuted among themselves."""
    at = [(i, next(c for c in classes if x in c)) for i, x in enumerate(text) if any(x in c for c in classes)]
    size, value = 1, 0
    for i, c in at:
        value, size = value * len(c) + c.index(text[i]), size * len(c)
    shape = "".join(str(classes.index(c)) for _, c in at)

    def filled(value: int) -> str:
        out = list(text)
        for i, c in reversed(at):
            value, k = divmod(value, len(c))
            out[i] = c[k]
        return "".join(out)

    return filled(permute(value, size, key, f"{tweak}:{shape}", within and (lambda v: within(filled(v)))))


DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """Sum of Luhn modulo 10; 0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


#: Lengths of the numbers of the issuers that have one, by the first digits.
CARD_LENGTHS = {"4": (13, 16, 19), "51": (16,), "52": (16,), "53": (16,), "54": (16,), "55": (16,), "34": (15,), "37": (15,)}


def _card(text: str, key: bytes) -> str | None:
    """The first two digits, which tell the issuer, stay."""
    digits = re.sub(r"\D", "", text)
    lengths = CARD_LENGTHS.get(digits[:1]) or CARD_LENGTHS.get(digits[:2]) or range(13, 20)
    if len(digits) not in lengths or luhn(digits) or len(set(digits)) == 1:
        return None
    body = _by_class(digits[2:-1], [DIGITS], key, f"card:{digits[:2]}")
    check = next(c for c in DIGITS if luhn(digits[:2] + body + c) == 0)
    return _refill(text, digits[:2] + body + check)


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class(plain[4:], [DIGITS, LARGE], key, f"iban:{plain[:2]}")
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


#: ITU country codes of one and two digits; the others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(text: str, key: bytes) -> str | None:
    """North American numbers are permuted among the valid ones, among those whose area starts with 0 or 1, or among those
    whose exchange does; of others the digits after the country code. Without a sign of a telephone (+, parentheses, or a
    1 that stands apart), an area that starts with 0 or 1 is refused."""
    digits = re.sub(r"\D", "", text)
    lead, d = digits[:-10], digits[-10:]
    if text[0] == "+" and not (lead == "1" and len(d) == 10):
        if not 8 <= len(digits) <= 15:
            return None
        code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
        return _refill(text, code + _by_class(digits[len(code) :], [DIGITS], key, f"phone:+{code}"))
    if d[0] in "01":
        if re.match(r"\d{2}", text):
            return None
        return _refill(text, f"{lead}{permute(int(d), 2 * 10**9, key, 'phone:area'):010d}")
    least, size, tweak = (0, 200, "phone:exchange") if d[3] in "01" else (200, 800, "phone")
    value = ((int(d[:3]) - 200) * size + int(d[3:6]) - least) * 10000 + int(d[6:])
    value = permute(value, 800 * size * 10000, key, tweak)
    area, rest = divmod(value, size * 10000)
    return _refill(text, f"{lead}{area + 200}{rest // 10000 + least:03d}{rest % 10000:04d}")


def _ssn(text: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in re.split(r"[- ]", text))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    value = permute(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn")
    area, rest = divmod(value, 99 * 9999)
    area += 1 + (area >= 665)
    return _refill(text, f"{area:03d}{rest // 9999 + 1:02d}{rest % 9999 + 1:04d}")


def _ipv4(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ipv6(text: str, key: bytes) -> str | None:
    """All ways to write an address have the same pseudonym, in the shortest way."""
    if sum(map(bool, text.split(":"))) < 3:
        return None
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permute(value, 1 << 128, key, "ipv6")))


FIRST, LAST = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()


def _moved(day: date, key: bytes, tweak: str, within: Callable[[date], bool] | None = None) -> date:
    """A day of 1900 to 2099 is permuted among those, another among the other years of four digits; and, where ``within``
    accepts it, among the days that it accepts."""
    n = day.toordinal()
    near = FIRST <= n < LAST
    same = lambda v: (FIRST <= v + 1 < LAST) == near and (within is None or within(date.fromordinal(v + 1)))
    return date.fromordinal(permute(n - 1, date.max.toordinal(), key, tweak, same) + 1) if not near else date.fromordinal(permute(n - FIRST, LAST - FIRST, key, tweak, within and (lambda v: within(date.fromordinal(v + FIRST)))) + FIRST)


def _real(year: str, month: str | int, day: str) -> date | None:
    try:
        return date(int(year), int(month), int(day))
    except ValueError:
        return None


#: Names of the months.
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
_NAMED = {k: "|".join(v) for k, v in MONTHS.items()}
#: A style of written dates: language, and the pattern whose groups are what stands before, between and after.
_WRITTEN = {
    "day month": ("en", rf"(?P<d>\d{{1,2}}) (?P<m>{_NAMED['en']}) (?P<y>\d{{4}})"),
    "month day": ("en", rf"(?P<m>{_NAMED['en']}) (?P<d>\d{{1,2}}), (?P<y>\d{{4}})"),
    "de": ("de", rf"(?P<d>\d{{1,2}})\. (?P<m>{_NAMED['de']}) (?P<y>\d{{4}})"),
    "fr": ("fr", rf"(?P<d>\d{{1,2}}) (?P<m>{_NAMED['fr']}) (?P<y>\d{{4}})"),
    "es": ("es", rf"(?P<d>\d{{1,2}}) de (?P<m>{_NAMED['es']}) de (?P<y>\d{{4}})"),
}
_WRITTEN_RE = {k: (lang, re.compile(p)) for k, (lang, p) in _WRITTEN.items()}


def _written_date(text: str, key: bytes) -> str | None:
    """Days with a leading zero are permuted among themselves, so that those without have other pseudonyms."""
    for style, (lang, pattern) in _WRITTEN_RE.items():
        if m := pattern.fullmatch(text):
            day = _real(m["y"], MONTHS[lang].index(m["m"]) + 1, m["d"])
            if day is None:
                return None
            zero = m["d"][0] == "0"
            new = _moved(day, key, f"date:{style}:{zero}", (lambda d: d.day < 10) if zero else None)
            out = {"d": f"{new.day:02d}" if zero else str(new.day), "m": MONTHS[lang][new.month - 1], "y": f"{new.year:04d}"}
            spans = sorted((m.span(k), k) for k in "dmy")
            return "".join(text[b[0][1] : c[0][0]] + out[c[1]] for b, c in zip([((0, 0), ""), *spans], spans))
    return None


def _date(text: str, key: bytes) -> str | None:
    """Of dates with slashes, those that can be read month first are; the others, whose day is above 12, are permuted among
    themselves, so that no two dates meet in one pseudonym."""
    if not text.isascii() or any(c.isalpha() for c in text):
        return _written_date(text, key)
    a, mark, b, _, c = re.split(r"([-/.])", text)
    if len(a) == 4:
        day = _real(a, b, c)
        return day and (lambda d: f"{d.year:04d}{mark}{d.month:02d}{mark}{d.day:02d}")(_moved(day, key, "date"))
    if mark == "/" and (day := _real(c, a, b)):
        d = _moved(day, key, "date")
        return f"{d.month:02d}/{d.day:02d}/{d.year:04d}"
    if not (day := _real(c, b, a)):
        return None
    d = _moved(day, key, "date:/d", lambda d: d.day > 12) if mark == "/" else _moved(day, key, "date")
    return f"{d.day:02d}{mark}{d.month:02d}{mark}{d.year:04d}"


def _email(text: str, key: bytes) -> str:
    name, _, host = text.rpartition("@")
    return _by_class(name, [DIGITS, SMALL, LARGE], key, "email:" + host.lower()) + "@" + host


def _token(body: str, key: bytes, tweak: str) -> str:
    """Hexadecimal bodies with digits and letters are permuted among themselves, and so are all others."""
    hexadecimal = lambda x: re.fullmatch(r"(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]+", x) is not None
    if hexadecimal(body):
        return _by_class(body, [DIGITS + "abcdef"], key, tweak, hexadecimal)
    return _by_class(body, [DIGITS, SMALL, LARGE], key, tweak, lambda x: not hexadecimal(x))


def _secret(text: str, key: bytes) -> str:
    fixed = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[a-z]-|", text)[0]
    return fixed + _token(text[len(fixed) :], key, "secret:" + fixed)


def _credential(text: str, key: bytes) -> str:
    start = re.match(r"[A-Za-z_-]+[\"']?\s*[=:]\s*[\"']?", text).end()
    return text[:start] + _token(text[start:], key, "credential")


FORMATS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"(?<![\w.+%-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", _email),
    "secret": (r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,})(?!\w)", _secret),
    "credential": (r"(?<!\w)(?i:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?\s*[=:]\s*[\"']?[^\s\"',;<>]{8,}(?<=[A-Za-z0-9])", _credential),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    "card": (r"(?<![\w.-])(?:\d{13,19}|\d{3,7}(?P<gap>[ -])\d{3,7}(?:(?P=gap)\d{3,7}){1,4}(?:(?P=gap)\d{1,3})?)(?!\w|-[A-Za-z_])", _card),
    "phone": (r"(?<![\w.])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+[1-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d){4,14})(?![\w-])", _phone),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ipv4),
    "ipv6": (r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)", _ipv6),
    "date": (r"(?<![\w./-])(?:(?:\d{4}(?P<ymd>[-/.])\d{2}(?P=ymd)\d{2}|\d{2}(?P<dmy>[-/.])\d{2}(?P=dmy)\d{4})(?:(?=[Tt]\d\d)|(?![\w/-]|\.\d))|(?:" + "|".join(re.sub(r"\?P<.>", "?:", p) for _, p in _WRITTEN.values()) + r")(?!\w))", _date),
}
_ONE = {k: re.compile(FORMATS[k][0]) for k in KINDS}
_ANY = re.compile("|".join(f"(?P<{k}>{FORMATS[k][0]})" for k in KINDS))
#: Kinds whose match may reach into words or numbers that follow, with the marks at which it is cut.
_CUTS = {"card": re.compile("[ -]"), "iban": re.compile(" "), "phone": re.compile(r"[ ./-]")}
_HINT = re.compile(r"[0-9@=]|sk-|gh[pousr]_|(?i:pass|pwd|secret|token|key)")


def _checked(kind: str, text: str, key: bytes) -> tuple[str, str] | None:
    """The longest valid value at the start of a match, and its pseudonym; ends are tried where a group of characters ends."""
    new = FORMATS[kind][1](text, key)
    if new is not None:
        return text, new
    for cut in reversed(list(_CUTS[kind].finditer(text)) if kind in _CUTS else []):
        part = text[: cut.start()]
        if _ONE[kind].fullmatch(part) and (new := FORMATS[kind][1](part, key)) is not None:
            return part, new
    return None


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int], list[tuple[int, int, str]]]:
    """The new text, how many values of each kind it had, and (start, end, kind) of each in the old text.

    A match that its kind's check refuses is tried with the shorter ends at its groups of characters, then again from its
    second character, so that it hides no other value.
    """
    counts: dict[str, int] = {}
    spans: list[tuple[int, int, str]] = []
    if not _HINT.search(text):
        return text, counts, spans
    out, at, copied = [], 0, 0
    while m := _ANY.search(text, at):
        found = None
        for kind in KINDS[KINDS.index(m.lastgroup) :]:
            one = m if m[kind] is not None else _ONE[kind].match(text, m.start())
            if one and (found := _checked(kind, one[0], key)):
                break
        if not found:
            at = m.start() + 1
            continue
        out += [text[copied : m.start()], found[1]]
        copied = at = m.start() + len(found[0])
        counts[kind] = counts.get(kind, 0) + 1
        spans.append((m.start(), at, kind))
    return ("".join([*out, text[copied:]]) if out else text), counts, spans


def pseudonyms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """Replace personal data in each whole text: ``doc_id, text, n_found, kinds`` (map of counts) and ``spans``.

    Card numbers (Luhn), IBANs (modulo 97), telephones (North American ones, and any with + and a country code), social
    security numbers, IPv4 and IPv6 addresses and calendar dates (in digits, or written in English, German, French or
    Spanish) count only if they are valid, and so are their pseudonyms; of mail addresses the name, of keys and
    hexadecimal tokens the random part, and of ``password=...`` and the like the value, is permuted within its classes of
    characters. A value has the same pseudonym in every document under the same ``key``, and different values of a format
    have different ones. Spans are positions in the old text.

    Whoever has the key can undo the pseudonyms, so there is no default: without the parameter it is the setting
    ``spark.daytrace.pii.key``, and without that a random key of this call, whose pseudonyms are linked within its result
    and with no other.

    One row per input row, without a shuffle; repeated rows give repeated results. A null text stays null, with no finds,
    as do empty ones. A null identifier stays null. Of formats that fit at the same place the first in ``KINDS`` counts. An
    empty table gives no rows. Other columns are not looked at, whatever their names. Memory is bounded by the longest text.
    """
    setting = docs.sparkSession.conf.get(KEY_SETTING, None)
    key = key or (hashlib.blake2b(setting.encode()).digest() if setting else secrets.token_bytes(32))

    def task(batches):
        for batch in batches:
            for ids, texts in rows_of(batch, ["id", "text"]):
                rows = [pseudonymise(t, key) if t is not None else (None, {}, []) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([sorted(r[1].items()) for r in rows], pa.map_(pa.string(), pa.int64())), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))],
                    ["doc_id", "text", "n_found", "kinds", "spans"],
                )

    schema = "doc_id long, text string, n_found long, kinds map<string,long>, spans array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, schema)
