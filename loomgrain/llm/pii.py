"""Surrogates for personal data: keyed, of the same kind, format, script and gender, and distinct.

Entities are found by pattern, normalised (digits of cards and phones, lower-case e-mails and names, each name part on its
own), and replaced by what a keyed hash of kind and normal form says, laid into the form as written; equal entities get
equal surrogates in all documents. Who has a title once is also found without it in the same document. Surrogates that two entities would share, or that occur as an entity themselves, are
found by a corpus-wide check and drawn again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.llm.common import forget, hot_keys, key_filter, spread_join, written

#: What each kind of entity looks like. The first group, where there is one, is what gets replaced.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,})",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key)\b\s*[=:]\s*[\"']?)([A-Za-z0-9+/_\-]{6,})",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\d)(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<!\d)\d{16}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w])",
    "person": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|господин|госпожа|Dr|Prof)\b\.? (?:(?:Dr|Prof)\b\.? )*([A-ZÀ-ÖØ-ÞА-Я][\w'\-]+(?: [A-ZÀ-ÖØ-ÞА-Я][\w'\-]+){0,2})",
}
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these holds no entity; a quick look spares most texts the patterns.
HINT = re.compile(r"[\d@=:]|\b(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|господин|госпожа|Dr|Prof|BEGIN)\b")
#: Titles that say a gender, and first names by script and gender.
FEMALE = {"mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "госпожа"}
FIRST = {
    ("latin", "f"): ("Alma", "Beata", "Carla", "Dora", "Elena", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karla", "Lena", "Maria", "Nora", "Olga", "Petra"),
    ("latin", "m"): ("Adam", "Bruno", "Carlo", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oskar", "Paul"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Павел"),
}
GENDER_OF = {name.lower(): gender for (_, gender), names in FIRST.items() for name in names}
#: Calling codes of one and two digits; all others have three.
CALLING = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})")
#: Syllables of made-up family names.
SYLLABLES = {
    "latin": ("ba", "den", "fer", "gol", "hin", "jor", "kel", "lam", "mor", "nev", "pol", "ros", "sal", "tor", "ver", "win"),
    "cyrillic": ("ба", "вер", "гол", "дан", "зор", "кел", "лам", "мор", "нев", "пол", "рос", "сал", "тор", "фер", "хин", "шев"),
}


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a whole text, in order; value is the normal form.

    Person values carry f:, m: or, for Dr and Prof, n: (no gender known). Full and family names that stand behind a title
    somewhere are found everywhere in the text; given names alone are not.
    """
    if not text or not HINT.search(text):
        return []
    out, people = [], []
    for m in ENTITY.finditer(text):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k) is not None)
        start, end = m.span()
        if kind in ("secret", "person"):
            inner = INNER[kind].match(m.group())
            start, end = start + inner.start(1), start + inner.end(1)
        if kind == "person":
            while text[end - 1] in "'-" or text[start:end].endswith("'s"):  # Mr Smith's
                end -= 1
            title = re.split(r"[. ]", m.group(), maxsplit=1)[0].lower()
            people.append((len(out), "f" if title in FEMALE else "n" if title in ("dr", "prof") else "m"))
        out.append((start, end, kind, normal(kind, text[start:end])))
    return _with_mentions(text, out, people) if people else out


def normal(kind: str, written_as: str) -> str:
    """What all ways to write an entity have in common."""
    if kind in ("email", "person"):
        return written_as.lower()
    if kind == "card":
        return re.sub(r"\D", "", written_as)
    if kind == "phone":
        return written_as[: written_as.startswith("+")] + re.sub(r"\D", "", written_as)
    return written_as.replace(" ", "") if kind == "iban" else written_as


def _with_mentions(text: str, found: list[tuple[int, int, str, str]], people: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
    """found with genders, and with what else in the text is a full or family name of its people."""
    genders: dict[tuple[str, str], str] = {}  # of (family, given); a title that tells it comes first, then a known given name
    families: dict[str, tuple[set[str], set[str]]] = {}
    for known in (True, False):
        for at, gender in people:
            *given, family = found[at][3].split(" ")
            for g in given:
                if (gender != "n") == known:
                    genders.setdefault((family, g), GENDER_OF.get(g, "n") if gender == "n" else gender)
    for at, gender in people:
        start, end, kind, value = found[at]
        *given, family = value.split(" ")
        found[at] = (start, end, kind, f"{genders[family, given[0]] if given and gender == 'n' else gender}:{value}")
        as_written = text[start:end].split(" ")
        names, firsts = families.setdefault(family, (set(), set()))
        names |= _cases(as_written[-1])
        for w in as_written[:-1]:
            firsts |= _cases(w)
    any_of = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    forms = [(rf"(?:(?:{any_of(firsts)})\s)*" if firsts else "") + f"(?:{any_of(names)})" for names, firsts in families.values()]
    mention = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(forms, key=lambda f: (-len(f), f)))})(?=s?(?!\w))")  # s: the Schneiders
    more, at = [], 0
    for start, end in [*((e[0], e[1]) for e in found), (len(text), len(text))]:
        for m in mention.finditer(text, at, start):
            if m.end() == start < len(text) and re.match(r"\w", text[start]):
                continue  # the first letters of an entity's word
            *given, family = m.group().lower().split()
            gender = genders.get((family, given[0]), "n") if given else "n"
            more.append((m.start(), m.end(), "person", f"{gender}:{' '.join([*given, family])}"))
        at = end
    return sorted(found + more)


def _cases(word: str) -> set[str]:
    return {word, word.upper(), *([word.capitalize()] if word.isupper() else [])}


INNER = {k: re.compile(PATTERNS[k]) for k in ("secret", "person")}


class _Draw:
    """A keyed stream of choices for one entity."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.bits, self.n = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.bits < n << 32:
            self.n += 1
            self.bits = int.from_bytes(hashlib.sha256(self.seed + bytes((self.n & 255, self.n >> 8))).digest(), "big")
        self.bits, r = divmod(self.bits, n)
        return r

    def like(self, s: str) -> str:
        """Another character of the same class for each of s; what is neither letter nor digit stays."""
        out = []
        for c in s:
            if c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c in "abcdef" and self.hex:
                out.append("abcdef"[self.below(6)])
            elif "a" <= c <= "z":
                out.append(chr(97 + self.below(26)))
            elif "A" <= c <= "Z":
                out.append(chr(65 + self.below(26)))
            elif "а" <= c.lower() <= "я":
                ch = chr(0x430 + self.below(32))
                out.append(ch if c.islower() else ch.upper())
            elif c.isalpha():
                ch = chr(97 + self.below(26))
                out.append(ch if c.islower() else ch.upper())
            else:
                out.append(c)
        return "".join(out)

    hex = False


@lru_cache(maxsize=50_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """What stands for an entry of entries_of(): never the entry itself."""
    salt = 0
    while True:
        d = _Draw(key, kind, value, attempt + 1_000_003 * salt)
        d.hex = kind == "secret" and re.fullmatch("[0-9a-f]+", value) is not None
        new = _make(d, kind, value, _more(kind, attempt + max(0, salt - 2)))
        if new != (value.split(" ")[1] if kind == "given" else value):
            return new
        salt += 1


def _more(kind: str, attempt: int) -> int:
    """How many syllables or characters an attempt adds, so that there is a free surrogate in the end, however many entities.

    Names and e-mails can be longer and still look right; the others keep their format until eight rounds are lost.
    """
    return (attempt + 1) // 2 if kind in ("given", "family", "email") else max(0, attempt - 8)


def _make(d: _Draw, kind: str, value: str, more: int = 0) -> str:
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        name, dot, top = domain.rpartition(".")
        return f"{d.like(local)}{d.like('a' * more)}@{d.like(name)}{dot}{top}"
    if kind == "given":  # a further name for each lost round: Alma-Dora
        gender, name = value[0], value.split(" ")[1]
        firsts = [x for g in ("fm" if gender == "n" else gender) for x in FIRST[_script(name), g]]
        return "-".join(firsts[d.below(len(firsts))] for _ in range(1 + more)).lower()
    if kind == "family":
        return _family(d, _script(value), (4 if len(value) > 6 else 3) + more)
    if kind == "private_key":
        lines = value.split("\n")
        if len(lines) > 2:
            return "\n".join([lines[0], *(d.like(x) for x in lines[1:-1]), *([d.like("0" * more)] if more else []), lines[-1]])
    return _same_format(d, kind, value) + d.like("0" * more)


def _same_format(d: _Draw, kind: str, value: str) -> str:
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "card":
        digits = d.like(re.sub(r"\D", "", value))[:-1]
        odd = [int(c) for c in digits[::-1]]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(odd))
        full = iter(digits + str(-total % 10))
        return "".join(next(full) if c.isdigit() else c for c in value)
    if kind == "phone":
        head = CALLING.match(value)  # the country stays
        cut = head.end() if head else 0
        return value[:cut] + d.like(value[cut:])
    if kind == "iban":
        return value[:2] + d.like(value[2:])
    if kind == "aws_key":
        return value[:4] + d.like(value[4:])
    if kind == "token":
        cut = re.match(r"gh[a-z]_|sk-|xox[a-z]-", value).end()
        return value[:cut] + d.like(value[cut:])
    return d.like(value)


def _script(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-я]", name) else "latin"


def _family(d: _Draw, script: str, n: int) -> str:
    """A made-up family name of n syllables, hyphenated after every sixth."""
    syl = [SYLLABLES[script][d.below(len(SYLLABLES[script]))] for _ in range(n)]
    return "-".join("".join(syl[k : k + 6]) for k in range(0, n, 6))


def entries_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(kind, value) of the hashed entries of an entity: itself, or the parts of a name.

    Family names are entries on their own, given names within their family: that family's Maria is the same everywhere.
    """
    if kind != "person":
        return [(kind, value)]
    *given, family = value[2:].split(" ")
    return [*(("given", f"{value[0]}:{family} {g}") for g in given), ("family", family)]


def laid(kind: str, new: list[str], written_as: str) -> str:
    """Surrogates of an entity's entries in the form in which it was written."""
    if kind == "person":
        parts = iter(new)
        return re.sub(r"\S+", lambda m: _cased_name(next(parts), m.group()), written_as)
    if kind == "email":
        return "@".join(_cased(n, w) for n, w in zip(new[0].rsplit("@", 1), written_as.rsplit("@", 1), strict=True))
    if kind in ("card", "phone", "iban"):
        rest = iter(new[0].removeprefix("+"))
        return "".join([*(next(rest) if c.isalnum() else c for c in written_as), *rest])
    return new[0]


def _cased(new: str, written_as: str) -> str:
    return "".join(c.upper() if k < len(written_as) and written_as[k].isupper() else c for k, c in enumerate(new))


def _cased_name(new: str, written_as: str) -> str:
    return new.upper() if len(written_as) > 1 and written_as.isupper() else "-".join(p.capitalize() for p in new.split("-"))


# ---------------------------------------------------------------- on tables


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start int, stop int, kind string, value string): every entity of every row of docs, by code points; value is normal."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1)):
                for e in find_entities(t.as_py()):
                    at.append(k)
                    out.append(e)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True))], names=["id", "start", "stop", "kind", "value"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, start int, stop int, kind string, value string")


def entries(found: DataFrame) -> DataFrame:
    """(id, kind, value), distinct: what entries_of() makes of entities()."""
    words = F.split(F.substring("value", 3, 1 << 30), " ")
    family = F.element_at(words, -1)
    given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda g: F.struct(F.lit("given").alias("kind"), F.concat(F.substring("value", 1, 2), family, F.lit(" "), g).alias("value")))
    own = F.array(F.struct("kind", "value"))
    parts = F.when(F.col("kind") == "person", F.concat(given, F.array(F.struct(F.lit("family").alias("kind"), family.alias("value"))))).otherwise(own)
    return found.select("id", F.explode(parts).alias("e")).select("id", "e.kind", "e.value").distinct()


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt int): the entries whose first surrogate isn't free, with the attempt that is.

    A surrogate is free if no other entry of the kind (for given names: and the family) has it, and it isn't an entry of
    the kind itself. Of those that share one, the first in order of value keeps it. Rounds go on for the rest, against all that is taken by then, until
    none is left; the space of surrogates grows with the attempt, so their number is a matter of the logarithm.
    """
    def scoped(kind: str, value: str, attempt: int) -> str:
        new = surrogate(key, kind, value, attempt)
        return f"{value[2:].split(' ')[0]} {new}" if kind == "given" else new

    def drawn(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([scoped(*r) for r in rows], pa.string())], names=["kind", "value", "attempt", "sub"])

        return df.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, sub string")

    known = written(found.select("kind", "value").distinct(), "entities")
    own = known.select(F.col("kind").alias("ok"), F.col("value").alias("os"))
    now = written(drawn(known.withColumn("attempt", F.lit(0))), "surrogates")
    taken = None
    done = None
    while True:
        first = now.groupBy(F.col("kind").alias("fk"), F.col("sub").alias("fs")).agg(F.min("value").alias("first"))
        marked = now.join(first, (F.col("kind") == F.col("fk")) & (F.col("sub") == F.col("fs")))
        marked = marked.join(own, (F.col("kind") == F.col("ok")) & (F.col("sub") == F.col("os")), "left")
        if taken is not None:
            marked = marked.join(taken, (F.col("kind") == F.col("tk")) & (F.col("sub") == F.col("ts")), "left")
        else:
            marked = marked.withColumn("ts", F.lit(None).cast("string"))
        free = (F.col("value") == F.col("first")) & F.col("os").isNull() & F.col("ts").isNull()
        marked = written(marked.select("kind", "value", "attempt", "sub", free.alias("free")), "marked")
        won = marked.filter("free")
        done = won if done is None else done.union(won)
        lost = marked.filter("not free")
        if lost.isEmpty():
            return done.filter("attempt > 0").select("kind", "value", "attempt")
        taken = done.select(F.col("kind").alias("tk"), F.col("sub").alias("ts"))
        forget(now)
        now = written(drawn(lost.withColumn("attempt", F.col("attempt") + 1)), "surrogates")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every entity of the text replaced, plus __entities array<struct<kind, start int, stop int, surrogate>>.

    start and stop are code points of the text given back. All other columns and rows stay, whatever their names (but a
    column __entities is replaced); null and empty texts stay as they are, with no entities; repeated rows and null ids
    stay; an empty table gives an empty table. Of most documents only entities, never texts, are shuffled: entities once for
    the distinctness check, known by the hash of their text; the texts with entities that had to be drawn again meet those
    attempts by a join, hot texts and entities dealt over many tasks. The key decides all surrogates; without it they can't
    be traced.
    """
    columns = [c for c in docs.columns if c != "__entities"]
    rest = [c for c in columns if c != text_col]
    hashed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.lit(0).alias("k")).alias("row"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    found = written(entries(entities(hashed, "h", "text")), "found")
    again = redrawn(found, key)
    name = F.concat_ws("\0", "kind", "value")
    again = written(again.select(name.alias("n"), "attempt"), "attempts")
    said = found.select(F.col("id").alias("h"), name.alias("name"))
    often = said.join(again.select("n"), F.col("name") == F.col("n"), "left_semi").groupBy("name").agg(F.count("*").alias("c"))
    per = spread_join(said, again, ("name", "n"), hot_keys(often, "name", found.count()))
    per = written(per.groupBy(F.col("h").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("again")), "again")
    nothing = F.lit(None).cast("map<string,int>")
    if per.isEmpty():
        joined = hashed.select("row", nothing.alias("again"), "text")
    else:
        told = key_filter(per, "of")
        some = hashed.filter(told("h"))
        hot = hot_keys(some.groupBy("h").agg(F.count("*").alias("c")), "h", docs.count())
        joined = hashed.filter(~told("h")).select("row", nothing.alias("again"), "text")
        joined = joined.unionByName(spread_join(some, per, ("h", "of"), hot, "left").select("row", "again", "text"))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("surrogate", pa.string())]))
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, seen = [], []
            for again_, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new, marks = replace_entities(t, key, dict(again_ or ()))
                texts.append(new)
                seen.append(marks)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(seen, spans)], names=["row", "text", "entities"])

    out = joined.mapInArrow(run, f"row {kind}, text string, entities array<struct<kind:string,start:int,stop:int,surrogate:string>>")
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"row.k{rest.index(c)}").alias(c) for c in columns], F.col("entities").alias("__entities"))


def replace_entities(text: str | None, key: bytes, again: dict[str, int] | None = None) -> tuple[str | None, list[dict]]:
    """A text with surrogates and where they stand in it."""
    found = find_entities(text)
    if not found:
        return text, []
    out, marks, at, n = [], [], 0, 0
    for start, end, kind, value in found:
        new = laid(kind, [surrogate(key, k, v, (again or {}).get(f"{k}\0{v}", 0)) for k, v in entries_of(kind, value)], text[start:end])
        n += start - at
        out += (text[at:start], new)
        marks.append({"kind": kind, "start": n, "stop": n + len(new), "surrogate": new})
        n += len(new)
        at = end
    return "".join([*out, text[at:]]), marks
