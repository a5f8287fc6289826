"""Personal data replaced by keyed surrogates of the same type and format.

Detected entities are reduced to a canonical value (digits of a number, lower case of an address, a
single name), so that every mention of one entity, however written, gets one surrogate. Candidates
come from a keyed hash. A Spark job over the distinct entities looks for surrogates that two
entities share or that are some entity's real value and moves those to their next candidate, until
none is left. Later candidates are longer, so a format never runs out of values. An address's domain is
an entity of its own: no two domains share a surrogate, and an address is kept apart within its domain.
Only entities that had to move need a table; all other surrogates follow from the key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import discard, free_name, saved, slices

# Forms of address by gender, and given names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): "Adam Boris Carl Daniel Edgar Felix Georg Hugo Ivan Jonas Karim Louis Marco Nils Oscar Pablo Ramon Simon Tomas Victor".split(),
    ("latin", "f"): "Agnes Berta Clara Diana Elena Flora Greta Helen Irene Julia Klara Laura Maria Nadia Olivia Paula Rosa Sonia Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Денис Егор Иван Кирилл Максим Николай".split(),
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Ирина Ксения Мария Нина Ольга".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Κατερίνα Λυδία Μαρία Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga ge ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе бо ва ве ви га да де ди ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти то".split(),
    "greek": "βα βε γα δα δε δι κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι τα τε τι το".split(),
}

#: Names that are words, too: they are taken for a name after a title only.
WORDS = frozenset("March April May June July August Summer Winter Day Long Short Young Old New White Black Brown Green Gray Grey Good Best Little Small Strong Rich Wise Swift Bright Page Price Rose Love King Bishop Klein Gross Lang Kurz Jung Alt Neu Weiss Schwarz Braun Lustig Stark Mai Juni Juli Sommer Winter Leon Blanco Delgado Mayo Junio Petit Grand Blanc Noir Mars Avril".split())
_VERSION = re.compile(r"(?i)(?:\bversion|\bver\.?|\brelease|\bv)[ :]?$")

_ALL_TITLES = sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)
_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩΆΈ-ΏА-Я"
_NAME = rf"(?:[{_CAPITAL}][^\W\d_]{{1,30}}|[{_CAPITAL}](?=['’]))(?:['’-][^\W\d_]{{1,30}}){{0,3}}"
_PART = re.compile(r"[^\W\d_]{2,}")
_QUICK = re.compile(r"[0-9@=:]|-----BEGIN|\b(?:" + "|".join(_ALL_TITLES) + r")\b")
_HEX = "[0-9A-Fa-f]"
_FIND = re.compile(
    r"(?P<email>[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})"
    r"|(?P<pem>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)(?P<body>[^-]{16,})(?=-----END [A-Z ]{0,30}PRIVATE KEY-----)"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<token>(?<![A-Za-z0-9_])(?:gh[opsru]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9_]))"
    r"|(?P<label>(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9+/_.~-]{8,})"
    rf"|(?P<mac>(?<![\w:-]){_HEX}{{2}}(?:[:-]{_HEX}{{2}}){{5}}(?![\w:-]))"
    rf"|(?P<ip6>(?<![\w:.])(?:{_HEX}{{1,4}}:){{1,7}}(?::?{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,5}}|:)(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![\w.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w.+-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
    rf"|(?P<title>\b(?:{'|'.join(_ALL_TITLES)})\.?[ ])(?P<names>{_NAME}(?:[ ]{_NAME})?)"
)


def _is_ip6(value: str) -> bool:
    groups = [g for g in value.split(":") if g]
    return any(c.isdigit() for c in value) and value.count("::") <= 1 and (len(groups) == 8 and "::" not in value or len(groups) in range(1, 8) and "::" in value)


def _luhn(digits: str) -> int:
    """The sum of digits before the check digit, modulo 10."""
    return sum((2 * d if d < 5 else 2 * d - 9) if i % 2 == 0 else d for i, d in enumerate(map(int, reversed(digits)))) % 10


def _luhn_ok(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def script_of(name: str) -> str:
    c = max(name)
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _gender(title: str, given: str | None) -> str:
    bare = title.strip(" .")
    of_title = next((g for g, ts in TITLES.items() if bare in ts), "n")
    if of_title != "n" or given is None:
        return of_title
    return next((g for (_, g), names in GIVEN.items() if given.capitalize() in names), "n")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of every mention, in order, not overlapping.

    Names are found after a title; each part of a name that was found once is then found wherever
    the text has it, written alike, but for names that are words as well.
    """
    if not _QUICK.search(text):
        return []
    found, named, titled = [], {}, []
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        if kind == "secret":
            # A value of letters alone is taken for a secret only where the label says password.
            if any(c.isdigit() for c in m["secret"]) or m["label"][:1] in "pP":
                found.append((*m.span("secret"), "secret", m["secret"]))
        elif kind == "body":
            found.append((*m.span("body"), "pem", m["body"]))
        elif kind == "names":
            words = m["names"].split(" ")
            gender, end = _gender(m["title"], words[0] if len(words) == 2 else None), m.start("names") + len(words[0])
            for part in _PART.finditer(text, *m.span("names")):
                of = f"given_{gender}" if len(words) == 2 and part.end() <= end else "surname"
                if part[0] in WORDS:
                    titled.append((*part.span(), of, part[0].lower()))
                else:
                    named.setdefault(part[0], of)
        elif kind == "ip6" and not _is_ip6(m[0]):
            continue
        elif kind == "ip" and _VERSION.search(text, max(0, m.start() - 12), m.start()):
            continue
        else:
            value = m[0]
            canonical = value.lower() if kind in ("email", "ip6") else re.sub("[:-]", "", value).lower() if kind == "mac" else value if kind in ("ip", "aws", "token") else re.sub(r"[^A-Z0-9+]", "", value)
            found.append((*m.span(), kind, canonical))
    if named:
        taken = [(a, b) for a, b, *_ in found]
        every = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(named, key=len, reverse=True)) + r")(?![^\W_])")
        at = 0
        for m in every.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                found.append((*m.span(), named[m[0]], m[0].lower()))
    return sorted(found + titled) if named or titled else found


class _Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = (key, f"{kind}\0{value}\0{attempt}".encode())
        self.pool, self.n = 0, 0
        self.block = 0

    def below(self, n: int) -> int:
        if self.n < 1 << 32:
            digest = hashlib.blake2b(self.seed[1] + self.block.to_bytes(4, "big"), key=self.seed[0], digest_size=32).digest()
            self.pool, self.n, self.block = int.from_bytes(digest, "big"), 1 << 256, self.block + 1
        self.pool, r = divmod(self.pool, n)
        self.n //= n
        return r


def _alike(s: _Stream, text: str, hexadecimal: bool = False) -> str:
    """Each letter and digit replaced by one of its class."""
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[s.below(16)])
        elif c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha() and c.isascii():
            out.append(chr((65 if c.isupper() else 97) + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def candidate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The attempt-th surrogate of an entity, in canonical form. Those of short values are kept."""
    return (_kept if len(value) <= 64 else _made)(key, kind, value, attempt)


#: Attempts at a length; after as many, candidates are a character longer.
_TRIES = 8


def _made(key: bytes, kind: str, value: str, attempt: int) -> str:
    s = _Stream(key, kind, value, attempt)
    more = attempt // _TRIES
    longer = lambda text: text + ("0" if text[-1:].isdigit() else "a") * more
    if kind == "email":
        # The domain stays: it has a surrogate of its own.
        local, _, domain = value.rpartition("@")
        return f"{_alike(s, longer(local))}@{domain}"
    if kind == "domain":
        name, dot, top = value.rpartition(".")
        return f"{_alike(s, longer(name))}{dot}{top}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "phone":
        lead = 2 if value.startswith("+") else 0
        return value[:lead] + _alike(s, longer(value[lead:]))
    if kind == "card":
        body = value[0] + _alike(s, longer(value[1:-1]))
        check = (10 - _luhn(body)) % 10
        return body + str(check if _luhn_ok(value) else (check + 1 + s.below(9)) % 10)
    if kind == "iban":
        body = value[:2] + "00" + _alike(s, longer(value[4:]))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"{body[:2]}{check:02d}{body[4:]}"
    if kind == "aws":
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in longer(value[4:]))
    if kind == "token":
        lead = re.match("[a-z]+[_-]", value)[0]
        return lead + _alike(s, longer(value[len(lead) :]))
    if kind == "ip6" and more:
        return ":".join(f"{s.below(1 << 16):04x}" for _ in range(8))  # a full address, where the short form ran out
    if kind in ("ip6", "mac"):
        return _alike(s, value, hexadecimal=True)
    if kind == "secret":
        return _alike(s, longer(value), hexadecimal=re.fullmatch("[0-9a-f]+", value) is not None)
    script = script_of(value)
    if kind.startswith("given"):
        gender = kind[-1] if kind[-1] != "n" else "mf"[s.below(2)]
        names = GIVEN[script, gender]
        # Past the listed names, a syllable is added, so that names never run out.
        extra = "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(attempt // 2))
        return (names[s.below(len(names))] + extra).lower()
    if kind == "surname":
        return "".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(3 + s.below(2) + more))
    return _alike(s, longer(value))


_kept = lru_cache(maxsize=20_000)(_made)


def render(mention: str, kind: str, surrogate: str) -> str:
    """The surrogate written the way the mention was: separators, brackets and case."""
    if kind in ("ip6", "mac"):
        surrogate = surrogate.upper() if mention.upper() == mention else surrogate
    if kind in ("phone", "card", "iban", "ssn", "mac"):
        chars = iter(surrogate)
        shown = "".join(next(chars, "") if c.isalnum() or c == "+" else c for c in mention)
        return shown + "".join(chars)
    if kind == "email" or kind == "surname" or kind.startswith("given"):
        return surrogate.upper() if mention.isupper() else surrogate.capitalize() if mention[:1].isupper() and kind != "email" else surrogate
    return surrogate


def _needed(kind: str, value: str) -> list[tuple[str, str]]:
    """The entities that a mention's surrogate is made of."""
    return [(kind, value), ("domain", value.rpartition("@")[2])] if kind == "email" else [(kind, value)]


def surrogate_of(key: bytes, kind: str, value: str, attempt_of) -> str:
    """The surrogate of a mention, given the attempt at which each entity was settled."""
    made = candidate(key, kind, value, attempt_of(kind, value))
    if kind == "email":
        domain = value.rpartition("@")[2]
        made = f"{made.rpartition('@')[0]}@{candidate(key, 'domain', domain, attempt_of('domain', domain))}"
    return made


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind, value: each entity of the corpus once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found = sorted({e for text in batch.column(0).to_pylist() if text for _, _, k, v in entities(text) for e in _needed(k, v)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    return docs.select("_text").mapInArrow(run, "kind string, value string").distinct()


def assign(found: DataFrame, key: bytes, patience: int = 50) -> DataFrame:
    """kind, value, attempt, surrogate: no two entities of a kind share a surrogate, and no surrogate
    is a real value.

    Of entities that drew alike the first in order of value has the surrogate; the others, and
    those that drew a real value or one that is taken, draw again. Only they go on to the next
    round. An error ends ``patience`` rounds in a row in which none could be settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([candidate(key, k, v, a) for k, v, a in rows], pa.string())], names=["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    # Given names of either gender draw on the same lists, so they are checked together.
    family = F.regexp_replace("kind", "^given_.*", "given").alias("_family")
    real = found.select(family, F.col("value").alias("surrogate")).distinct()
    drawing, drawing_at, settled, idle = found.withColumn("attempt", F.lit(0)), None, None, 0
    while True:
        drawn = saved(drawing.mapInArrow(run, schema), "surrogates-drawn")
        first = drawn.groupBy(family, "surrogate").agg(F.min(F.struct("kind", "value", "attempt")).alias("_e")).join(real, ["_family", "surrogate"], "left_anti")
        if settled is not None:
            first = first.join(settled.select(family, "surrogate"), ["_family", "surrogate"], "left_anti")
        won = saved(first.select("_e.*", "surrogate"), "surrogates")
        settled = won if settled is None else settled.union(won)
        if drawing_at is not None:
            discard(drawing_at)
        drawing = drawing_at = saved(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "surrogates-drawing")
        discard(drawn)
        if not drawing.head(1):
            discard(drawing_at)
            return settled
        idle = 0 if won.head(1) else idle + 1
        if idle == patience:
            raise ValueError("entities are left without a surrogate; their formats have too few values")


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text: str = "text", broadcast_limit: int = 100_000) -> DataFrame:
    """``docs`` with every mention in ``text`` replaced, and n_entities, entity_types added.

    Entities that had to move past their first candidate go to the workers as a small table when
    there are at most ``broadcast_limit``, else each document gets its own by a join on id and text.
    Null texts stay null, empty ones empty; texts without entities come back unchanged; repeated
    rows are replaced alike, null ids like any other; all other columns are kept as they are. Where
    a column is called n_entities or entity_types already, the added one has an underscore more.
    """
    source = docs.select(F.col(text).alias("_text"))
    found = saved(distinct_entities(source), "entities")
    moved = assign(found, key).where("attempt > 0").select("kind", "value", "attempt")
    few = moved.limit(broadcast_limit + 1).count() <= broadcast_limit
    table = {(r["kind"], r["value"]): r["attempt"] for r in moved.collect()} if few else {}
    columns = docs.columns
    moves_name = free_name("_moves", columns)
    n_name = free_name("n_entities", columns)
    types_name = free_name("entity_types", [*columns, n_name])
    rows = docs.withColumn(moves_name, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    if not few:
        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for whole in batches for part in slices(whole, 2)):
                out = [(i, k, v) for i, t in enumerate(b.column(2).to_pylist()) if t for k, v in {e for _, _, k, v in entities(t) for e in _needed(k, v)}]
                at = pa.array([o[0] for o in out], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["_id", "_hash", "kind", "value"])

        kind = docs.schema[id_column].dataType.simpleString()
        said = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text)).mapInArrow(mentions, f"_id {kind}, _hash long, kind string, value string").distinct()
        moves = said.join(moved, ["kind", "value"]).groupBy("_id", "_hash").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_own"))  # of one text
        same = docs[id_column].eqNullSafe(moves["_id"]) & (F.xxhash64(docs[text]) == moves["_hash"])
        rows = docs.join(moves, same, "left").select(*(docs[c] for c in columns), F.col("_own").alias(moves_name))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_name, T.LongType()), T.StructField(types_name, T.StringType())])
    place = columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempts = shared.value
        for batch in (part for whole in batches for part in slices(whole, place)):
            texts, numbers, kinds = batch.column(place).to_pylist(), [], []
            moves = batch.column(len(columns)).to_pylist()
            for i, t in enumerate(texts):
                said = entities(t) if t else []
                numbers.append(len(said))
                kinds.append(",".join(sorted({k for _, _, k, _ in said})))
                if said:
                    own = {(m["kind"], m["value"]): m["attempt"] for m in moves[i] or []}
                    out, end = [], 0
                    attempt_of = lambda k, v, own=own: own.get((k, v)) or attempts.get((k, v), 0)
                    for a, b, k, v in said:
                        out += [t[end:a], render(t[a:b], k, surrogate_of(key, k, v, attempt_of))]
                        end = b
                    texts[i] = "".join([*out, t[end:]])
            kept = [batch.column(c) for c in range(len(columns))]
            kept[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), pa.array(kinds, pa.string())], names=schema.names)

    return rows.mapInArrow(replace, schema)
