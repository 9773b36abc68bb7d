"""PII: detected entities get keyed surrogates of their own type, gender, script and format."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream

# --- keyed bijections ------------------------------------------------------------------------


def permute(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed bijection of range(size), or its inverse: a balanced Feistel network, walked until it is back in range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    salt = hashlib.blake2b(tweak.encode(), digest_size=16).digest()

    def mixed(r: int, b: int) -> int:
        f = hashlib.blake2b(bytes([r]) + salt + b.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width + 8)).digest()
        return int.from_bytes(f * (-(-width // len(f))), "big") & mask

    while True:
        a, b = x >> half, x & mask
        for r in range(7, -1, -1) if back else range(8):
            a, b = (b ^ mixed(r, a), a) if back else (b, a ^ mixed(r, b))
        x = a << half | b
        if x < size:
            return x


def moved(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed bijection of range(size) without fixed points: the next number on one cycle through all, in the order of permute."""
    return permute((permute(x, size, key, tweak) + 1) % size, size, key, tweak, back=True)


_ALPHABETS = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "äöüàâéèêëîïôùûáíóúñçß",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщьъ",
    "αεηιουω",
    "βγδζθκλμνξπρσφχψτ",
]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = "0123456789abcdef"


def reshaped(text: str, key: bytes, tweak: str, keep: int = 0, alphabets=None) -> str:
    """text with each digit, vowel and consonant (by script, case kept) replaced in kind, by a bijection of all texts of that shape.

    The first `keep` characters, and those of no alphabet, stay. Texts of one shape get distinct
    replacements, and none is its own, unless it is the only one of its shape.
    """
    digits, shape = [], []
    for i, c in enumerate(text):
        low = c.lower()
        a = None if i < keep else (alphabets if alphabets and low in alphabets else _CLASS.get(low)) if len(low) == 1 else None
        shape.append((a, c != low))
        if a:
            digits.append((a.index(low), len(a)))
    size = x = 0
    if digits:
        size = 1
        for d, n in digits:
            x, size = x * n + d, size * n
    if size < 2:
        return text
    mark = f"{tweak}|{keep}|{''.join('.' if a is None else a[0].upper() if u else a[0] for a, u in shape)}|{text[:keep]}"
    y = moved(x, size, key, mark)
    out = []
    for a, up in reversed(shape):
        if a is None:
            out.append("")
            continue
        y, d = divmod(y, len(a))
        out.append(a[d].upper() if up else a[d])
    out.reverse()
    return "".join(o or c for o, c in zip(out, text, strict=True))


# --- surrogates by type ----------------------------------------------------------------------

GIVEN = {
    ("latin", "f"): "Maria Anna Emma Laura Julia Sofia Clara Elena Alice Marie Claire Camille Sophie Isabelle Carmen Lucia Pilar Ingrid Greta Heike Susan Linda Karen Mary Jane Sarah Emily Olivia Grace Helen Ruth Paula Nina Eva Rosa Ida".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Karl Jürgen Stefan Klaus Pierre Jean Louis Michel André Carlos José Juan Luis Miguel Pedro Antonio Henry Oscar Simon Felix Hugo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
}
_POOL = {name.lower(): pool for pool, names in GIVEN.items() for name in names}


def name_part(word: str, key: bytes) -> str:
    """A surrogate for one word of a name: a listed given name becomes another of its script and gender, any other word one of its shape with the same last letter. Case is kept, and makes no other word."""
    low = word.lower()
    if len(low) != len(word):  # a letter whose lower case is two
        low = word
    if pool := _POOL.get(low):
        names = GIVEN[pool]
        i = [n.lower() for n in names].index(low)
        # a keyed cyclic order of the pool: each name is followed by another
        order = sorted(range(len(names)), key=lambda j: hashlib.blake2b(names[j].encode(), key=key[:64], digest_size=8).digest())
        new = names[order[(order.index(i) + 1) % len(names)]]
        return new.upper() if word.isupper() and len(word) > 1 else new.lower() if word.islower() else new
    body, last = low[:-1], low[-1:]
    new = reshaped(body, key, "name") + last
    while new in _POOL:  # listed names are taken: walk on, as a bijection may
        new = reshaped(new[:-1], key, "name") + last
    return "".join(c.upper() if w != w.lower() else c for c, w in zip(new, word, strict=True))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _card(text: str, key: bytes) -> str:
    d = re.sub(r"\D", "", text)
    if luhn(d):
        new = reshaped(d[:-1], key, "card", 1)
        return _refill(text, next(new + c for c in "0123456789" if luhn(new + c)))
    new = reshaped(d, key, "card", 1)
    while luhn(new):
        new = reshaped(new, key, "card", 1)
    return _refill(text, new)


#: Country codes of two digits; those that start with 1 or 7 have one, others three.
_TWO = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(text: str, key: bytes) -> str:
    d = re.sub(r"\D", "", text)
    keep = (1 if d[0] in "17" else 2 if d[:2] in _TWO else 3) if text.startswith("+") else int(d[0] == "0")  # by digits alone, however they are grouped
    return _refill(text, reshaped(d, key, "phone", min(keep, max(0, len(d) - 6))))


def _ip(text: str, key: bytes) -> str:
    if ":" in text:
        return reshaped(text, key, "ip6", 0, _HEX)
    x = 0
    for p in text.split("."):
        x = x << 8 | int(p)
    y = moved(x, 1 << 32, key, "ip4")
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, _, tld = domain.lower().rpartition(".")  # a domain's surrogate is the same for all its addresses
    return f"{reshaped(local.lower(), key, 'local')}@{reshaped(name, key, 'domain')}.{tld}"


def _iban(text: str, key: bytes) -> str:
    bare = text.replace(" ", "")
    body = reshaped(bare[4:], key, "iban")
    check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
    it = iter(f"{bare[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _secret(text: str, key: bytes) -> str:
    keep = next((len(p) for p in ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "xoxb-", "eyJ") if text.startswith(p)), 0)
    return reshaped(text, key, "secret", keep, _HEX if re.fullmatch("[0-9a-f]+", text) else None)


def surrogate(kind: str, text: str, key: bytes, again: int = 0) -> str:
    """The replacement of an entity: a function of key, kind and the entity, injective for each kind up to separators and case. again: another one."""
    return _made(kind, text, hashlib.blake2b(again.to_bytes(4, "big"), key=key[:64]).digest() if again else key)


def plain(kind: str, text: str) -> str:
    """text without the separators and case that don't tell entities of the kind apart."""
    if kind in ("phone", "card", "iban"):
        return re.sub(r"[^\w+]|_", "", text)
    return re.sub(r"\s+", " ", text.lower()) if kind in ("email", "name") else text


@lru_cache(100_000)
def _made(kind: str, text: str, key: bytes) -> str:
    if kind == "name":
        return re.sub(r"[^\W\d_]+", lambda m: name_part(m[0], key), text)
    f = {"card": _card, "phone": _phone, "ip": _ip, "email": _email, "iban": _iban, "secret": _secret}.get(kind)
    return f(text, key) if f else reshaped(text, key, kind)


# --- detection -------------------------------------------------------------------------------

#: Issuers' prefixes and lengths of card numbers.
_ISSUER = re.compile(r"(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:2[2-9]|[3-6]\d|7[01])\d{13}|2720\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12,15}|(?:5[06-9]|6\d)\d{14,17})$")

_AT = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}(?![\w-])")
_NUMERIC = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)"
    r"|(?P<ip6>(?i:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=[0-9a-f:]{0,40}\d)[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>[3-6]\d{3}(?:[ -]?\d{4}){3}|3\d{3}[ -]?\d{6}[ -]?\d{5}|\d{13,19})"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{6,8}|0\d{1,4}(?:[ -]\d{2,4}){3,4})"
    r")(?!\w)"
)
_SECRET = re.compile(
    r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)\b[\"']?\s{0,3}(?:=|:)\s{0,3}[\"']?)(?P<a>[^\s\"',;]{6,})"
    r"|\b(?P<b>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abps]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})\b"
)
_TITLE = re.compile(
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία)\b\.? "
    r"(?P<n>[^\W\d_a-zа-яα-ω][^\W\d_]{1,30}(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]{1,30}){0,2})"
)
_INTRO = re.compile(r"(?i:\b(?:my name is|mein name ist|ich heiße|je m'appelle|me llamo|меня зовут|με λένε)) (?P<n>[^\W\d_a-zа-яα-ω][^\W\d_]{1,30}(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]{1,30}){0,2})")
_INTROS = ("name", "heiße", "appelle", "llamo", "зовут", "λένε")
_ARTICLES = ("the ", "The ", "a ", "A ", "an ", "An ")
_TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Господин", "Госпожа", "Κύρι", "Κυρί")
_KEYWORDS = ("passw", "pwd", "passphrase", "secret", "token", "key", "auth")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_", "sk-", "xox", "eyJ")
_DIGIT = re.compile(r"\d")


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, in order and without overlaps; secrets and emails go before numbers, names last."""
    found: list[tuple[int, int, int, str]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS) or any(k in text for k in _PREFIXES):
        for m in _SECRET.finditer(text):
            g = "a" if m["a"] else "b"
            value = m[g].rstrip(".!?)") if g == "a" else m[g]
            if len(value) < 6 or (g == "a" and value.isalpha() and ":" in text[m.start() : m.start("a")] and not m[0].lower().startswith(("pass", "pwd"))):
                continue  # prose after a colon
            found.append((0, m.start(g), m.start(g) + len(value), "secret"))
    if "@" in text:
        found += [(1, m.start(), m.end(), "email") for m in _AT.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMERIC.finditer(text):
            kind = m.lastgroup
            if kind == "card":
                d = re.sub(r"\D", "", m[0])
                if not luhn(d) or not _ISSUER.match(d):
                    continue
            if kind == "iban":
                bare = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
                    continue
            found.append((2, m.start(), m.end(), {"ip6": "ip"}.get(kind, kind)))
    names = {m["n"] for m in _TITLE.finditer(text)} if any(t in text for t in _TITLES) else set()
    if any(t in low for t in _INTROS):
        names |= {m["n"] for m in _INTRO.finditer(text)}
    if names:  # later mentions without the title: the whole name or one of its words, also all in capitals
        parts = names | {w for n in names for w in re.split("[ -]", n) if len(w) > 2}
        parts |= {p.upper() for p in parts}
        again = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, parts), key=lambda x: (-len(x), x))) + r")\b")
        found += [(3, m.start(), m.end(), "name") for m in again.finditer(text) if not text[max(0, m.start() - 4) : m.start()].endswith(_ARTICLES)]
    out: list[tuple[int, int, str]] = []
    if found:
        taken: list[tuple[int, int]] = []
        for _, a, b, kind in sorted(found):
            k = bisect.bisect_left(taken, (a, b))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            taken.insert(k, (a, b))
            out.append((a, b, kind))
    return sorted(out)


def replace_pii(docs: DataFrame, secret: bytes, *, key: str = "doc_id", text: str = "text", again: Mapping[tuple[str, str], int] | None = None) -> DataFrame:
    """(key, text, entities) for each row of docs; entities: array of (start, end, kind, surrogate), in characters of the given text.

    Every entity of the whole text is replaced by its surrogate, a function of the secret and the
    entity alone: the same entity has the same surrogate in all documents, whoever handles them, and different entities
    have different ones, since each format is permuted by a keyed bijection (collisions() checks it). Digits
    stay digits, letters keep script, case and kind (vowel, consonant), separators, country codes, card brands, check digits and top-level
    domains stay valid; listed given names become others of their gender. Text outside entities stays as it is.

    again: what settled() found for these docs.

    A null text stays null without entities, an empty one empty. Repeated rows and null keys are
    each handled; columns other than key and text aren't read. One pass, no shuffle.
    """

    def run(r: pa.RecordBatch, off, data) -> pa.RecordBatch:
        out, n, flat = [], [0], []
        has = r.column(1).to_pylist()
        for i, s in enumerate(r.column(2).to_pylist()):
            found = entities(s)
            at, parts = 0, []
            for a, b, kind in found:
                new = surrogate(kind, s[a:b], secret, again.get((kind, plain(kind, s[a:b])), 0) if again else 0)
                flat.append({"start": a, "end": b, "kind": kind, "surrogate": new})
                parts += [s[at:a], new]
                at = b
            out.append(None if not has[i] else "".join([*parts, s[at:]]) if found else s)
            n.append(len(flat))
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())])
        return pa.RecordBatch.from_arrays([r.column(0), pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(flat, kind))], names=["_key", "_out", "entities"])

    kind = docs.schema[key].dataType.simpleString()
    got = stream(docs, [F.col(key), F.col(text).isNotNull().alias("_has"), F.coalesce(F.col(text), F.lit("")).alias("_text")], run, f"_key {kind}, _out string, entities array<struct<start:long,end:long,kind:string,surrogate:string>>")
    return got.select(F.col("_key").alias(key), F.col("_out").alias(text), "entities")


def _shared(docs: DataFrame, secret: bytes, text: str, again: Mapping[tuple[str, str], int] | None = None) -> DataFrame:
    """(kind, surrogate, entities): surrogates of more than one entity, separators and case aside. Entities are combined before their shuffle."""

    def run(r: pa.RecordBatch, off, data) -> pa.RecordBatch | None:
        found = set()
        for s in r.column(0).to_pylist():
            for a, b, kind in entities(s):
                own = plain(kind, s[a:b])
                found.add((kind, plain(kind, surrogate(kind, s[a:b], secret, again.get((kind, own), 0) if again else 0)), own))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["kind", "surrogate", "entity"]) if found else None

    got = stream(docs, [F.coalesce(F.col(text), F.lit("")).alias("_text")], run, "kind string, surrogate string, entity string")
    return got.distinct().groupBy("kind", "surrogate").agg(F.sort_array(F.collect_list("entity")).alias("entities")).where(F.size("entities") > 1)


def collisions(docs: DataFrame, secret: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, surrogate, n): surrogates that more than one entity has, separators and case aside; none are expected."""
    return _shared(docs, secret, text).select("kind", "surrogate", F.size("entities").cast("long").alias("n"))


def settled(docs: DataFrame, secret: bytes, *, key: str = "doc_id", text: str = "text", rounds: int = 8) -> dict[tuple[str, str], int]:
    """(kind, entity) -> again, so that no two entities of docs share a surrogate: of those that do, all but the first in order take another, until none does.

    A pass over docs for each round, mostly one; only the entities found come to the driver.
    """
    again: dict[tuple[str, str], int] = {}
    for _ in range(rounds):
        both = _shared(docs, secret, text, again).collect()
        if not both:
            return again
        for r in both:
            for e in r.entities[1:]:
                again[r.kind, e] = again.get((r.kind, e), 0) + 1
    raise RuntimeError("entities still share surrogates")


def pii_digest(docs: DataFrame, secret: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_entities, kinds, text) of replace_pii after settled(); kinds distinct, sorted and comma-joined."""
    again = settled(docs, secret, key=key, text=text)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e.kind))), ",")
    return replace_pii(docs, secret, key=key, text=text, again=again).select(key, F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), text)
