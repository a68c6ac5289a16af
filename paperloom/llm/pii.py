"""Surrogates for personal data: keyed, type-consistent, distinct, and the same for each mention.

An entity is (kind, canonical form): digits for numbers, lower case for addresses, a word
with its part and gender for names. A surrogate is drawn from a keyed hash of the entity
and an attempt, has the same kind and length, and is written in the format of each
mention: punctuation, grouping and case stay. Given names keep their gender, all names
their script. A title tells the gender of the person it stands with, in the whole text;
else a list of given names does. Names found once are replaced wherever else they stand.

Collision checks run over the distinct entities of all documents and compare what is read: a
surrogate may belong to one entity only, of whatever kind, and may not be an entity that
occurs. Of those that draw the same one the smallest keeps it, the rest draw again, from a
space that grows with the attempts (by letters, digits or syllables), so the search ends.
Tasks draw first attempts themselves; only entities that needed more are looked up, from a
broadcast table up to `broadcast_rows` of them, beyond that by a join on the documents that
mention them.

Defined results: null text stays null; a null id stays null; repeated rows get the same
surrogates; rows without entities keep their text as it is; an empty table gives no rows;
other columns, of any name, are kept or ignored.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterable, Iterator
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperloom.llm.common import discard, materialize, text_batches

EMAIL = re.compile(r"[\w.%+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}")
NUMBER = re.compile(r"(?<![\w.])[+(]?\d[\d ().-]{5,}\d(?![\w])")
IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)")
IPV6, HAS_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f]*(?![\w:.])"), re.compile(r"::|:[0-9A-Fa-f]{1,4}:")
CARD = re.compile(r"(?<![\dA-Za-z.-])(?<![A-Z]{2}\d{2} )\d(?:[ -]?\d){12,18}(?![\d-])")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]\d{2,4}){2,4}(?!\w)|(?<![\w.+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\w)")
#: What PHONE and CARD take, but is a date (with dots or hyphens, spaces may part a phone number) or a list of years.
DATE = re.compile(r"(?<![\d.-])(?:(?:1\d|20)\d\d([.-])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([.-])(?:0?[1-9]|[12]\d|3[01])\2(?:1\d|20)\d\d)(?![.-]?\d)")
YEARS = re.compile(r"(?:(?:1[5-9]|20)\d\d[ .-])+(?:1[5-9]|20)\d\d")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Countries whose account numbers are taken for such even if their check digits are wrong.
COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT", "BE", "PT", "PL")
#: Endings that a name has in other cases.
ENDINGS = ("s", "ом", "ым", "ой", "а", "у", "е", "ы")
#: Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "г-н": "m", "господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Doña": "f", "г-жа": "f", "госпожа": "f",
    "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n",
}
#: Frequent given names.
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Mark Paul Peter George Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques François Philippe José Carlos Miguel Juan Pedro Иван Сергей Алексей Дмитрий Михаил Γιώργος Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Emma Olivia Alice Helen Ursula Monika Petra Sabine Ingrid Marie Sophie Camille Nathalie Isabelle María Carmen Lucía Isabel Elena Анна Мария Елена Ольга Наталья Ελένη Μαρία".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
CAP = re.compile(r"\b[A-ZÀ-ÞΑ-ΩА-ЯЁ][\w'’-]+")
NAME = r"[A-ZÀ-ÞΑ-ΩА-ЯЁ][\w'’-]+"
TITLED = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ]((?:{NAME}[  ])?(?:{NAME}[  ])?{NAME})")
NAMED = re.compile(rf"\b({'|'.join(sorted(GENDER, key=len, reverse=True))})[  ]({NAME})")
#: What stands before a name.
CUES = re.compile(rf"\b(?:[Nn]ame(?:\s+is\b|\s*:)|[Cc]ontact\s*:|[Aa]uthor\s*:|[Ss]igned by\b|[Aa]ttn\.?\s*:|[Mm]ein Name ist\b|[Ii]ch heiße\b|[Jj]e m['’]appelle\b|[Mm]e llamo\b|[Мм]еня зовут\b|[Мм]ое имя\b|[Мм]е λένε\b|[Μμ]ε λένε\b)\s+({NAME}(?:[  ]{NAME}){{1,2}})")
#: Frequent family names, forms of address and cues in Han script.
HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"
HAN = re.compile(rf"([{HAN_FAMILY}])([\u4e00-\u9fff]{{0,2}}?)(先生|女士|小姐|太太|教授|博士)|(?:姓名[:：]\s*|名叫|我叫)([\u4e00-\u9fff])([\u4e00-\u9fff]{{1,2}})(?![\u4e00-\u9fff])")
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "教授": "n", "博士": "n"}
#: Syllables that surrogate names are made of, and endings by gender.
SYLLABLES = {
    "Latin": ("ba be bi bo bra da del dor el fa fen gal ha hel jo ka kel la len lor ma mel mir na nel nor pa per ra rel ro sa sel sol ta tel tor va vel vin wen za".split(), {"m": "n r s k d".split(), "f": "a ia ina elle ette".split(), "n": "e i y l t".split()}),
    "Cyrillic": ("ба бе бо ва ве вла да де до за зе ка ке ко ла ле лю ма ме ми на не ни па пе по ра ре ро са се со та те то фа хо ча ша".split(), {"m": "н р й к в".split(), "f": "а я на ра ля".split(), "n": "о и е у ы".split()}),
    "Han": (list("安柏昌德恩方光海嘉景康立民宁平庆仁善泰文祥新永远云泽正中"), {"m": list("刚强军勇杰"), "f": list("芳娜静丽娟"), "n": list("平文华明安")}),
    "Greek": ("βα βε γα γε δα δη ζα θε κα κε λα λε μα με νι νο πα πε ρα ρο σα σε τα τε φι χα".split(), {"m": "ς ος ης ας ων".split(), "f": "α η ια ω ίνα".split(), "n": "ι ο υ ε ου".split()}),
}
KINDS = ("email", "ip", "ipv6", "iban", "card", "ssn", "phone", "name")
FOUND = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def script(word: str) -> str:
    c = ord(word[0])
    return "Greek" if 0x370 <= c <= 0x3FF else "Cyrillic" if 0x400 <= c <= 0x52F else "Han" if 0x4E00 <= c <= 0x9FFF else "Latin"


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def checks(plain: str) -> bool:
    """Whether the check digits of an account number without spaces are right."""
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account(mention: str) -> str | None:
    """The account number that a mention is, or begins with if words in capitals follow it."""
    enough = lambda t: len(t.replace(" ", "")) >= 15 and sum(map(str.isdigit, t)) >= 10
    text = mention
    while enough(text):
        if checks(text.replace(" ", "")):
            return text
        text = text.rpartition(" ")[0]
    return mention if mention[:2] in COUNTRIES and enough(mention) else None


def dated(mention: str, least: int) -> bool:
    """Years, or dates beside which fewer than `least` digits stand."""
    return YEARS.fullmatch(mention) is not None or DATE.search(mention) is not None and sum(map(str.isdigit, DATE.sub("", mention))) < least


def bare(word: str) -> str:
    """A name without its possessive ending."""
    return re.sub(r"['’](?:[sS])?$", "", word) or word


def ipv6(text: str) -> str | None:
    try:
        return IPv6Address(text).compressed
    except ValueError:
        return None


def persons(text: str) -> Iterator[tuple[list[tuple[int, str]], str]]:
    """(start, word) of the words of each name that a title, a cue or a listed given name shows, and the gender its title tells."""

    def words(at: int, name: str) -> list[tuple[int, str]]:
        return [(at + w.start(), bare(w[0])) for w in re.finditer(r"\S+", name)]

    caps = CAP.findall(text)
    if not TITLE_WORDS.isdisjoint(caps) or "г-" in text or "господин" in text or "госпожа" in text:
        for m in TITLED.finditer(text):
            yield words(m.start(2), m[2]), TITLES[m[1]]
    if len(caps) > 1:
        for m in CUES.finditer(text):
            yield words(m.start(1), m[1]), "n"
        if not GENDER.keys().isdisjoint(caps):
            for m in NAMED.finditer(text):
                yield [(m.start(1), m[1]), (m.start(2), bare(m[2]))], "n"


def han_names(text: str) -> list[tuple[int, str, str]]:
    """(start, word, canonical) of names in Han script: family name first; each found name everywhere it stands."""
    known: dict[str, tuple[str, str, str]] = {}
    out = []
    for m in HAN.finditer(text):
        family, given, gender = (m[1], m[2], HAN_TITLES[m[3]]) if m[1] else (m[4], m[5], "n")
        if given:
            if family + given in known and known[family + given][2] != "n":
                gender = known[family + given][2]
            known[family + given] = (family, given, gender)
        else:
            out.append((m.start(1), family, f"family|n|{family}"))
    if known:
        for m in re.finditer("|".join(sorted(map(re.escape, known), key=len, reverse=True)), text):
            family, given, gender = known[m[0]]
            out += [(m.start(), family, f"family|n|{family}"), (m.start() + len(family), given, f"given|{gender}|{given}")]
    return out


def stem_in(known: dict[str, str], word: str) -> str | None:
    """The known name that a word is, or is with an ending; names of three letters have none."""
    if word in known:
        return word
    return next((word[: -len(e)] for e in ENDINGS if len(word) - len(e) > 3 and word.endswith(e) and word[: -len(e)] in known), None)


def names(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, word, canonical) of all mentions of names."""
    found = list(persons(text))
    pair_gender: dict[tuple[str, str], str] = {}
    word_gender: dict[str, str] = {}
    for words, gender in found:
        if gender != "n":
            for _, given in words[:-1]:
                pair_gender.setdefault((given, words[-1][1]), gender)
                word_gender.setdefault(given, gender)
    known: dict[str, str] = {}
    firsts = set()
    for words, _ in sorted(found, key=lambda f: f[0][0][0]):
        family = words[-1][1]
        for k, (start, word) in enumerate(words):
            if start in firsts:
                continue
            firsts.add(start)
            if k < len(words) - 1:
                gender = pair_gender.get((word, family)) or word_gender.get(word) or GENDER.get(word, "n")
                canonical = f"given|{gender}|{word.lower()}"
            else:
                canonical = f"family|n|{word.lower()}"
            known.setdefault(word, canonical)
            yield start, word, canonical
    if known:  # later and earlier mentions of these names on their own, in any capitals, with an ending
        low = {w.lower(): c for w, c in known.items()}
        for m in CAP.finditer(text):
            word = bare(m[0])
            stem = stem_in(low, word.lower())
            if stem and m.start() not in firsts:
                yield m.start(), word[: len(stem)], low[stem]
    if not text.isascii():
        yield from han_names(text)


Found = tuple[int, int, str, str]


def merged(kept: list[Found], more: Iterable[Found]) -> list[Found]:
    """Both in text order, without those of `more` that overlap one of `kept` or an earlier one of their own."""
    new, k, end = [], 0, 0
    for x in sorted(more):
        while k < len(kept) and kept[k][1] <= x[0]:
            k += 1
        if x[0] >= end and (k == len(kept) or x[1] <= kept[k][0]):
            new.append(x)
            end = x[1]
    return sorted(kept + new) if new else kept


def find(text: str) -> list[Found]:
    """(start, end, kind, canonical) in text order, without overlaps: earlier kinds first."""
    got: dict[str, list[Found]] = {k: [] for k in KINDS}
    if "@" in text:
        got["email"] = [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if HAS_IPV6.search(text):
        got["ipv6"] = [(m.start(), m.end(), "ipv6", c) for m in IPV6.finditer(text) if len(m[0]) > 4 and (c := ipv6(m[0]))]
    for area in NUMBER.finditer(text):  # the rest is looked for where there are numbers
        a, b = area.span()
        for kind, pattern in (("ip", IP), ("card", CARD), ("ssn", SSN), ("phone", PHONE)):
            for m in pattern.finditer(text, a, b):
                digits = re.sub(r"\D", "", m[0])
                if kind == "ip":
                    got[kind].append((m.start(), m.end(), kind, m[0]))
                elif kind == "card" and 13 <= len(digits) <= 19 and (luhn(digits) or len(digits) == 16 and not dated(m[0], 13)) or kind == "ssn" or kind == "phone" and 7 <= len(digits) <= 15 and not dated(m[0], 7):
                    got[kind].append((m.start(), m.end(), kind, digits))
    got["iban"] = [(m.start(), m.start() + len(a), "iban", a.replace(" ", "")) for m in IBAN.finditer(text) if (a := account(m[0]))]
    got["name"] = [(start, start + len(word), "name", canonical) for start, word, canonical in names(text)]
    kept: list[Found] = []
    for kind in KINDS:
        if got[kind]:
            kept = merged(kept, got[kind])
    return kept


TITLE_WORDS = {t for t in TITLES if t[0].isupper()}


class Stream:
    """Keyed pseudorandom numbers of one entity and attempt."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.what, self.n, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.bits < 32:
            self.pool = int.from_bytes(hmac.digest(self.key, self.what + b"%d" % self.n, "sha256"), "big")
            self.n, self.bits = self.n + 1, 256
        self.pool, r = divmod(self.pool, n)
        self.bits -= max(1, n.bit_length())
        return r


def own_octets(a: int, b: int) -> int:
    """Leading octets that say that an address is private or local; these stay."""
    return 1 if a in (10, 127) else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b <= 31 else 0


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """Canonical form of the surrogate: same kind, same length where the format asks for it, longer after many attempts."""
    s = Stream(key, kind, canonical, attempt)
    more = attempt // 4
    if kind == "email":
        local, _, domain = canonical.partition("@")
        name, dot, top = domain.rpartition(".")
        swap = lambda t: "".join(str(s.below(10)) if c.isdigit() else chr(97 + s.below(26)) if c.isalpha() else c for c in t)
        return f"{swap(local + 'x' * more)}@{swap(name)}{dot}{top}"
    if kind == "ip" and attempt < 64:
        least = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        octets = canonical.split(".")
        bounds = [least[len(o)] if not more else (1, 254) for o in octets]
        kept = octets[: own_octets(*map(int, octets[:2]))]
        return ".".join(kept + [str(lo + s.below(hi - lo + 1)) for lo, hi in bounds][len(kept) :])
    if kind in ("ip", "ipv6"):  # groups of zeros stay, others keep their length
        groups = IPv6Address(canonical).exploded.split(":") if kind == "ipv6" else ["ffff"] * 8
        size = lambda g: 4 if more else len(g.lstrip("0"))
        new = ["%x" % (16 ** (size(g) - 1) + s.below(15 * 16 ** (size(g) - 1))) if size(g) else "0" for g in groups]
        return IPv6Address(":".join(new)).compressed
    if kind == "name":
        part, gender, word = canonical.split("|")
        syllables, endings = SYLLABLES[script(word)]
        n = (len(word) - 1 if script(word) == "Han" else 2 + (len(word) > 6)) + more  # longer where many are taken
        return "".join(syllables[s.below(len(syllables))] for _ in range(n)) + endings[gender if part == "given" else "n"][s.below(5)]
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in canonical[4:] + "0" * more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    digits = [str(s.below(10)) for _ in canonical + "0" * more]
    keep = 1 if kind in ("card", "phone") else 0
    digits[:keep] = canonical[:keep]
    if kind == "card" and luhn(canonical):
        digits[-1] = next(d for d in "0123456789" if luhn("".join(digits[:-1]) + d))
    return "".join(digits)


def written(mention: str, kind: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind == "name":
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    if kind == "ip":
        return new
    if kind == "ipv6":
        long = len(mention) == 39
        text = IPv6Address(new).exploded if long else new
        return text.upper() if any(c.isupper() for c in mention) else text
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new)) if len(mention) == len(new) else new
    left = iter(new)
    return "".join(next(left, "") if c.isalnum() else c for c in mention) + "".join(left)


def entities(rows: DataFrame, with_key: bool = False) -> DataFrame:
    """Distinct entities of each batch of documents; with the document's row key if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({(k if with_key else 0, kind, c) for k, text in zip(batch.column(0).to_pylist(), batch.column(1)) for _, _, kind, c in find(text.as_py())})
            cols = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "canonical"])

    return text_batches(rows).mapInArrow(run, "key long, kind string, canonical string")


def drawn(table: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, surrogate) for rows (kind, canonical, attempt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canonical", "attempt", "surrogate"])

    return table.select("kind", "canonical", "attempt").mapInArrow(run, "kind string, canonical string, attempt int, surrogate string")


def again(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first surrogate collides; attempt makes it distinct."""
    settled = materialize(drawn(found.withColumn("attempt", F.lit(0)), key))
    real = materialize(found.select(F.substring_index("canonical", "|", -1).alias("surrogate")).distinct())
    order = F.struct("attempt", "kind", "canonical")
    while True:
        best = settled.groupBy("surrogate").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
        shared = settled.join(best, "surrogate").where(order != F.col("best")).select("kind", "canonical", "attempt")
        taken = settled.join(real, "surrogate", "left_semi").select("kind", "canonical", "attempt")
        lost = materialize(shared.unionByName(taken).distinct())
        if lost.isEmpty():
            return settled.where("attempt > 0").select("kind", "canonical", "attempt")
        redrawn = drawn(lost.withColumn("attempt", F.col("attempt") + 1), key)
        before, settled = settled, materialize(settled.join(lost.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select("kind", "canonical", "attempt", "surrogate").unionByName(redrawn))
        discard(before, lost)


def attempts_beyond_first(texts: DataFrame, key: bytes, broadcast_rows: int) -> tuple[dict, DataFrame | None]:
    """Entities (of rows text) that needed more than one attempt: a table, or by text key if they are many."""
    rows = texts.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("key"), "text")
    found = materialize(entities(rows).select("kind", "canonical").distinct())
    moved = materialize(again(found, key))
    if moved.count() <= broadcast_rows:
        return {(r.kind, r.canonical): r.attempt for r in moved.collect()}, None  # bounded by broadcast_rows
    own = entities(rows, True).distinct().join(moved, ["kind", "canonical"])
    return {}, own.groupBy("key").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("moved"))


def rewrite(text: str | None, key: bytes, attempts: dict) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and where they stand in it."""
    parts, places, at, size = [], [], 0, 0
    for start, end, kind, canonical in find(text) if text else ():
        new = written(text[start:end], kind, surrogate(key, kind, canonical, attempts.get((kind, canonical), 0)))
        parts += [text[at:start], new]
        size += start - at
        places.append({"kind": kind, "start": size, "end": size + len(new), "surrogate": new})
        size, at = size + len(new), end
    return "".join([*parts, text[at:]]) if parts else text, places


def rewritten(docs: DataFrame, key: bytes, text_col: str, broadcast_rows: int, places: bool) -> DataFrame:
    """`docs` with its texts replaced; with n_entities and entities behind its columns if `places`."""
    table, own = attempts_beyond_first(docs.select(F.col(text_col).alias("text")), key, broadcast_rows)
    # Names that no column of `docs` has, in any case.
    long = "_" * max(map(len, docs.columns))
    if own is None:
        rows = docs.withColumn(long + "moved", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        own = own.withColumnsRenamed({"key": long + "key", "moved": long + "moved"})
        rows = docs.join(own, F.xxhash64(docs[text_col]) == own[long + "key"], "left").drop(long + "key")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    column = docs.columns.index(text_col)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = shared.value
        for batch in batches:
            got = []
            for text, own in zip(batch.column(column), batch.column(batch.num_columns - 1)):
                own = own.as_py()
                got.append(rewrite(text.as_py(), key, {(m["kind"], m["canonical"]): m["attempt"] for m in own} if own else attempts))
            columns = batch.columns[:-1]
            columns[column] = pa.array([g[0] for g in got], pa.string())
            names = batch.schema.names[:-1]
            if places:
                columns += [pa.array([len(g[1]) for g in got], pa.int32()), pa.array([g[1] for g in got], spans)]
                names += ["n_entities", "entities"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType(list(docs.schema))
    if places:
        schema = StructType([*schema, *StructType.fromDDL(f"n_entities int, entities {FOUND}")])
    return text_batches(rows).mapInArrow(run, schema)


def anonymize(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Per row: id, text with surrogates, n_entities, and where which surrogate stands in the new text."""
    return rewritten(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), key, text_col, broadcast_rows, True)


def anonymize_in_place(docs: DataFrame, key: bytes, text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """All columns of `docs`, its texts with surrogates."""
    return rewritten(docs, key, text_col, broadcast_rows, False)
