"""Personal data replaced by surrogates of the same kind, look, script and gender.

An entity's surrogate is a keyed permutation of all strings of its shape: digits stay digits, letters stay letters of
their case and script, separators stay, card check digits keep their state. A permutation keeps different entities of a
shape different and equal ones equal, in all documents.

A person is a given name and a surname, each an entity of its own, so that "Mr John Smith" and "Mr Smith" keep one
surname. A given name of the list becomes another of its gender and script (one to one; given names are borne by many,
so that others have it doesn't matter). Other given names and surnames keep their last letter, which often tells the gender.

Whether two entities got one surrogate, or a surrogate is the text of a real entity of its kind, is then checked over
the whole corpus: entities are gathered once each (folded where they are read), joined on their surrogates, and the
later of two that collide tries again, until none collides. Names and mails try again in an open space, each time two
syllables wider, so even a shape of which all texts occur is left in a round or two. Numbers, addresses and keys keep
their format and try another permutation of it; where a kind has so many entities that a format could be over 1/`ROOM`
full, its surrogates are a plain permutation of it, which keeps them distinct but may give one that is real elsewhere.
Only entities that had to try again are joined back to documents; up to `small` of them (counted first) go as a list with
the task, more are joined by document.

Defined cases: a null text stays null. Texts without entities are unchanged. Repeated rows are changed alike. Extra
columns are kept as they are. Empty table, empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt_join, give_back, materialize, release, slices

KEY = b"tidemark surrogate key"
SMALL = 10_000
ROOM = 64
ROUNDS = 16

#: Common given names by script and gender: fixed values.
NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Sara Emma Clara Sofia Lena Paula Alice Nora Eva Marta Irene Helen Diana Rosa Ines Carmen Lucia Elena Karin Monika Petra Sabine Ursula Mary Linda Susan Karen Nancy Betty Sandra Ashley Emily Jane Camille Chloe Manon".split(),
    ("latin", "m"): "John Peter Paul Thomas Martin David Daniel Lucas Felix Simon Carlos Jorge Luis Pedro Pablo Hans Klaus Jürgen Stefan Uwe Pierre Jean Michel Louis Antoine James Robert William Richard Charles Joseph Mark George Steven Brian Kevin Jason Frank Eric Adam".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Алина Вера Нина Галина Лариса".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Виктор Олег Юрий Максим Роман Егор Антон Кирилл".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα Ιωάννα Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Γιάννης Νίκος Δημήτρης Κώστας Παναγιώτης Βασίλης Χρήστος".split(),
}
#: Forms of address and their gender: fixed values.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "г-н": "m", "г-жа": "f", "Κύριος": "m", "Κυρία": "f"}
GIVEN = {name: kind for kind, names in NAMES.items() for name in names}
#: Letters that stand for one another, by script and case.
ALPHABETS = ["0123456789", "bcdfghjklmnpqrstvwxz", "aeiouy", "BCDFGHJKLMNPQRSTVWXZ", "AEIOUY", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "çñß", "ÇÑ", "бвгджзйклмнпрстфхцчшщ", "аеиоуыэюя", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "АЕИОУЭЮЯ", "βγδζθκλμνξπρστφχψ", "αεηιουω", "άέήίόύώ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΑΕΗΙΟΥΩ", "ΆΈΉΊΌΎΏ"]
CLASS = {c: a for a in ALPHABETS for c in a}
#: Consonants and vowels of invented syllables.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζθκλμνπρστφ", "αειου")}
#: Kinds whose texts may be longer than their entity.
OPEN = {"surname", "email"}
HEX = ["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefABCDEF"]

EMAIL = re.compile(r"[\w.+%-]*\w@[\w-]+(?:\.[\w-]+)+")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
SECRET = re.compile(r"\b(?:[0-9a-fA-F]{32,128}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})\b")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<=\+)\d{6,14})(?![\w-])|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(\.?)[ ]((?:[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?)(?: [^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?)?)")
NAMED = re.compile(r"(?<!\w)(" + "|".join(sorted(GIVEN, key=len, reverse=True)) + r") ([^\W\d_a-zа-яα-ω][^\W\d_]{2,})(?!\w)")
DIGIT = re.compile(r"\d")
#: Words that begin like names do; `\w` alone would also take the rest of a word.
CAPITAL = re.compile(r"(?<!\w)[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]*|(?<!\w)г-(?:н|жа)")
CUES = {*TITLES, *GIVEN}
WITH_DIGITS = [("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("ip", IP)]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the entities, in order; of overlapping ones the first kind found."""
    starts: list[int] = []
    found: list[tuple[int, int, str, str]] = []

    def add(kind, start, end):
        at = bisect_left(starts, end)  # of those before its end, the last reaches furthest
        if at == 0 or found[at - 1][1] <= start:
            starts.insert(at, start)
            found.insert(at, (start, end, kind, text[start:end]))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    if DIGIT.search(text):  # all of these hold a digit
        for m in SECRET.finditer(text):
            if any(c.isdigit() for c in m[0]):
                add("secret", *m.span())
        for kind, pattern in WITH_DIGITS:
            for m in pattern.finditer(text):
                add(kind, *m.span())
    if not CUES.isdisjoint(CAPITAL.findall(text)):
        for m in PERSON.finditer(text):
            add(f"person-{TITLES[m[1]]}", *m.span(3))
        for m in NAMED.finditer(text):
            add(f"person-{GIVEN[m[1]][1]}", *m.span())
    return found


def parts(text: str) -> tuple[int, list[tuple[int, int, str, str]]]:
    """How many entities find has, and their parts: a person's given name and surname stand alone."""
    found, out = find(text), []
    for start, end, kind, entity in found:
        if not kind.startswith("person"):
            out.append((start, end, kind, entity))
            continue
        first, _, rest = entity.partition(" ")
        given = bool(rest) or first in GIVEN
        out.append((start, start + len(first), f"given-{kind[-1]}" if given else "surname", first))
        if rest:
            out.append((end - len(rest), end, "surname", rest))
    return len(found), out


class Surrogates:
    def __init__(self, key: bytes = KEY):
        self.key = key
        self.known: dict = {}
        self.turned = {kind: sorted(names, key=lambda n: self.number("order", n)) for kind, names in NAMES.items()}

    def number(self, *parts) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256)[:16], "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of range(size) that leaves no value in place: a step along a keyed order of all values."""
        if size < 2:
            return value
        step = 1 + self.number("step", size, tweak) % (size - 1)
        return self.feistel((self.feistel(value, size, tweak, True) + step) % size, size, tweak)

    def feistel(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A Feistel network or its inverse, walked until it lands inside range(size)."""
        half = max(1, -(-(size - 1).bit_length() // 2))
        low, salt = (1 << half) - 1, hashlib.md5(tweak.encode()).digest()
        wide = max(8, half // 8 + 1) if half < 480 else 64
        mix = lambda turn, x: int.from_bytes(hashlib.blake2b(b"%d %x" % (turn, x), digest_size=wide, key=self.key[:64], salt=salt).digest(), "big") & low
        while True:
            left, right = value >> half, value & low
            if back:
                for turn in reversed(range(6)):
                    left, right = right ^ mix(turn, left), left
            else:
                for turn in range(6):
                    left, right = right, left ^ mix(turn, right)
            value = (left << half) | right
            if value < size:
                return value

    def shaped(self, text: str, tweak: str, alphabet: str | None = None) -> str:
        """text with the characters of each alphabet permuted within the texts of this shape."""
        if alphabet is None:
            classes = [CLASS.get(c) for c in text]
        else:
            classes = [alphabet if c in alphabet else None for c in text]
        out = []
        for at in range(0, len(text), 48):  # blocks bound the numbers; each block's tweak holds what stands before
            part, kinds = text[at : at + 48], classes[at : at + 48]
            value, size = 0, 1
            for c, kind in zip(part, kinds):
                if kind:
                    value, size = value * len(kind) + kind.index(c), size * len(kind)
            shape = "".join(str(ALPHABETS.index(k)) if k in ALPHABETS else "h" if k else c for c, k in zip(part, kinds))
            value = self.permute(value, size, f"{tweak}|{shape}|{text[:at]}")
            made = []
            for c, kind in zip(reversed(part), reversed(kinds)):
                if kind:
                    value, digit = divmod(value, len(kind))
                    c = kind[digit]
                made.append(c)
            out += reversed(made)
        return "".join(out)

    def of(self, kind: str, entity: str, attempt: int = 0) -> str:
        """The surrogate of a part, or of a whole person at the first attempt."""
        if kind.startswith("person"):
            first, _, rest = entity.partition(" ")
            given = self.of(f"given-{kind[-1]}" if rest or first in GIVEN else "surname", first, attempt)
            return f"{given} {self.of('surname', rest, attempt)}" if rest else given
        key = (kind, entity, attempt)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = self._made(kind, entity, attempt)
        return self.known[key]

    def name(self, word: str, tweak: str, attempt: int) -> str:
        """Another name of the word's shape; with two more syllables before the last letter for each attempt."""
        keep = 1 if len(word) > 3 and word[-1].isalpha() else 0
        body, end = word[: len(word) - keep], word[len(word) - keep :]
        return self.shaped(body, f"name{tweak}{attempt}|{end}") + self.syllables(word, f"{tweak}{attempt}", 2 * attempt) + end

    def syllables(self, text: str, tweak: str, count: int) -> str:
        """Consonant and vowel, count times, in the script of text."""
        hard, soft = SOUNDS[_script(text)]
        n, out = self.number("syllables", tweak, text), []
        for _ in range(count):
            n, i = divmod(n, len(hard))
            n, j = divmod(n, len(soft))
            out.append(hard[i] + soft[j])
        return "".join(out)

    def _made(self, kind: str, entity: str, attempt: int) -> str:
        tweak = f"{kind}{attempt}"
        if kind.startswith("given"):
            names = self.turned.get((_script(entity), kind[-1]), ())
            if entity in names:
                return names[(names.index(entity) + 1 + self.number("turn", kind) % (len(names) - 1)) % len(names)]
            return self.name(entity, kind, attempt)
        if kind == "surname":
            return " ".join(self.name(w, kind, attempt) for w in entity.split(" "))
        if kind == "secret" and (alphabet := next((a for a in HEX if all(c in a for c in entity)), None)):
            return self.shaped(entity, tweak, alphabet)
        if kind == "email":
            name, _, host = entity.rpartition("@")
            labels = host.split(".")
            return self.shaped(name, tweak) + self.syllables(entity, tweak, 2 * attempt) + "@" + ".".join([*(self.shaped(x, "host") for x in labels[:-1]), labels[-1]])
        if kind == "ip":
            value = 0
            for x in entity.split("."):
                value = value * 256 + int(x)
            return ".".join(map(str, self.permute(value, 1 << 32, tweak).to_bytes(4, "big")))
        if kind == "card":
            digits = [c for c in entity if c.isdigit()]
            off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
            last = max(i for i, c in enumerate(entity) if c.isdigit())
            body = self.shaped(entity[:last], tweak)
            return body + str((_luhn([c for c in body if c.isdigit()]) + off) % 10)
        if kind == "phone" and entity.startswith("+"):
            m = re.match(r"\+\d{1,3}(?=[ .-])|\+\d", entity)
            return m[0] + self.shaped(entity[m.end() :], tweak + m[0])
        if kind == "iban":
            return entity[:2] + self.shaped(entity[2:], tweak + entity[:2])
        return self.shaped(entity, tweak)


def closed(kind: str, entity: str, count: int) -> bool:
    """Whether `count` entities of the kind could leave an entity's fixed format too little room."""
    if count == 0 or kind in OPEN or kind.startswith("given"):
        return False
    size = 1
    for c in entity[2:] if kind == "iban" else entity:
        size *= len(CLASS[c]) if c in CLASS else 1
    return size < ROOM * count


def _luhn(digits: list[str]) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


_MAKERS: dict = {}


def maker(key: bytes) -> Surrogates:
    return _MAKERS.setdefault(key, None) or _MAKERS.__setitem__(key, Surrogates(key)) or _MAKERS[key]


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of the parts in all texts, folded in the tasks that read them."""
    arrow = pa.schema([("kind", pa.string()), ("entity", pa.string())])

    def run(batches):
        for b in slices(batches, rows=4096):
            got = sorted({(k, e) for t in b.column("text").to_pylist() if t for _, _, k, e in parts(t)[1]})
            if got:
                yield batch(arrow, list(zip(*got)))
        give_back()

    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "kind string, entity string").distinct()


def assigned(found: DataFrame, key: bytes = KEY, make=None, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, surrogate, attempt) with no surrogate given twice within a kind, nor, but for those that are free
    of it (listed given names, formats without room), equal to an entity of the kind."""
    arrow = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string()), ("attempt", pa.int32()), ("free", pa.bool_())])
    spec = "kind string, entity string, surrogate string, attempt int, free boolean"
    found = materialize(found, "entities")
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # a row for each kind

    def run(batches):
        own = make or maker(key).of
        for b in batches:
            k, e, n = (b.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
            free = [not make and (x.startswith("given") and y in GIVEN or closed(x, y, counts[x])) for x, y in zip(k, e)]
            yield batch(arrow, [k, e, [own(*x) for x in zip(k, e, n)], n, free])

    now = materialize(found.select("kind", "entity", F.lit(0).alias("attempt")).mapInArrow(run, spec), "surrogates")
    release(found)
    for _ in range(rounds):
        real = now.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        # the entity with the fewest attempts, then the least, keeps a surrogate; a free one before others
        keeper = now.groupBy("kind", "surrogate").agg(F.min(F.struct(~F.col("free"), "attempt", "entity")).alias("keeper"), F.count("*").alias("given"))
        bad = keeper.join(real, ["kind", "surrogate"], "left").where("given > 1 or real").select("kind", "surrogate", F.coalesce("real", F.lit(False)).alias("real"), F.col("keeper.entity").alias("keeps"))
        marked = now.join(bad, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("real") & ~F.col("free") | (F.col("keeps") != F.col("entity")), F.lit(False))
        marked = materialize(marked.select("kind", "entity", "surrogate", "attempt", "free", again.alias("again")), "surrogates-marked")
        release(now)
        redo = marked.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if redo.isEmpty():
            return marked.drop("again", "free")
        now = materialize(marked.where("not again").drop("again").unionByName(redo.mapInArrow(run, spec)), "surrogates")
        release(marked)
    raise RuntimeError("surrogates still collide")


def replace(docs: DataFrame, key: bytes = KEY, small: int = SMALL, make=None) -> DataFrame:
    """docs with the entities of text replaced; all columns kept, and pii_entities (their number) added."""
    special = assigned(entities(docs), key, make).where("attempt > 0").select("kind", "entity", "surrogate")
    count = special.count()
    name = "pii_entities"
    while name in docs.columns:
        name += "_"
    fields = docs.schema.fields
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    where = [f.name for f in fields].index("text")

    def changed(text, own, differ):
        if text is None:
            return None, 0
        out, at, (number, found) = [], 0, parts(text)
        for start, end, kind, entity in found:
            out += [text[at:start], differ.get((kind, entity)) or own(kind, entity, 0)]
            at = end
        return "".join(out) + text[at:], number

    def run(batches, differ=None):
        own = make or maker(key).of
        for b in batches:
            lists = b.column("pii_again_").to_pylist() if differ is None else [None] * b.num_rows
            texts = b.column(where).to_pylist()
            got = [changed(t, own, differ if differ is not None else {(x["kind"], x["entity"]): x["surrogate"] for x in l or []}) for t, l in zip(texts, lists)]
            columns = [pa.array([g[0] for g in got], pa.string()) if i == where else b.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[1] for g in got], pa.int32())], [f.name for f in fields] + [name])
        give_back()

    out = f"{spec}, `{name}` int"
    if count <= small:
        differ = {(r["kind"], r["entity"]): r["surrogate"] for r in special.collect()}
        return docs.mapInArrow(lambda b: run(b, differ), out)

    # documents that hold such entities, by a digest of the text
    arrow = pa.schema([("pii_digest_", pa.int64()), ("kind", pa.string()), ("entity", pa.string())])

    def held(batches):
        for b in slices(batches):
            rows = sorted({(d, k, e) for d, t in zip(b.column("pii_digest_").to_pylist(), b.column("text").to_pylist()) if t for _, _, k, e in parts(t)[1]})
            if rows:
                yield batch(arrow, list(zip(*rows)))

    # an entity of very many texts, and a text of very many rows, are dealt over several tasks
    hashed = docs.withColumn("pii_digest_", F.xxhash64("text"))
    uses = hashed.select("pii_digest_", "text").where("text is not null").mapInArrow(held, "pii_digest_ long, kind string, entity string").distinct()
    uses = uses.withColumn("pii_name_", F.struct("kind", "entity")).drop("kind", "entity")
    lists = dealt_join(uses, special.select(F.struct("kind", "entity").alias("pii_name_"), "surrogate"), "pii_name_", "pii_digest_")
    lists = lists.groupBy("pii_digest_").agg(F.collect_list(F.struct("pii_name_.kind", "pii_name_.entity", "surrogate")).alias("pii_again_"))
    return dealt_join(hashed, lists, "pii_digest_", F.spark_partition_id(), "left").select(*docs.columns, "pii_again_").mapInArrow(run, out)
