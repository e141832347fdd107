"""Personal items in free text, by bootstrapped contextual extraction.

Shapes that an item of a kind may have give candidates, each with its instance (the item without regard to its spelling) and its patterns: the words
around it, its form, its words, its host, its kind of street. Seeds are instances known beforehand: the persons and addresses of an identity table, published samples, numbers with a country's prefix or
beside a word that names them, and whole street addresses. In a graph of patterns and instances, scored with tables, a pattern is good if enough of its instances are
known, and an instance becomes known if it has a good pattern; this is repeated. So the seeds find the phrases and forms in which items stand, and these find the items that no list has.
A list of persons stays as it is while the texts grow, so that ever less of what stands even in the best phrase is known. What is enough is therefore measured against the share that is usual where the known ones stand.
A seed only starts the search: what is accepted in the end is what has a good pattern, seed or not.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import written

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 4
#: A context is good if this share of its instances is known, and at least LEAST_KNOWN of them.
GOOD_SHARE, LEAST_KNOWN = 0.4, 2
#: Of e-mail addresses few are known beforehand, and what looks like one is rarely anything else: here a lesser share will do.
EMAIL_SHARE = 0.05
#: A context with so many known instances is also good if it has these shares of what is usual in such contexts of its kind.
MANY_KNOWN = 10
#: Parts into which the instances of a pattern are split where patterns are joined to them.
SALTS = 16

# Published sample items, which belong to nobody. They go through the same extraction as texts, as seeds.
EXAMPLES = (
    "SSN 078-05-1120", "SSN 219-09-9999", "NINO QQ123456A", "NINO QQ123456C", "passport X1234567", "passport C0123456", "phone +1 (202) 555-0143", "phone +44 20 7946 0958", "phone (202) 555-0178", "phone (202) 555-0196",
    "10 Downing Street, London", "221 Baker Street, London", "350 Fifth Avenue, York", "1600 Pennsylvania Avenue, Washington", "1 Abbey Road, London", "3 Savile Row, London", "12 Penny Lane, Liverpool", "4 Privet Drive, Surrey",
    "jane.doe@example.com", "john@example.org", "jane [at] example.com", "john [at] example.org", "jane(at)example.com", "john(at)example.org", "jane%40example.com", "john%40example.org",
)

# Words that name a kind of number, and words that end or begin a street's name.
_ID_WORDS = re.compile(r"\b(?:ssn|social|tax|tin|insurance|passport|identity|id card|nino|national id|driver'?s? licen[cs]e)\b", re.I)
_PHONE_WORDS = re.compile(r"\b(?:tel|telephone|phone|mobile|cell|pager|fax|call|text me|dial)\b", re.I)
_STREET = re.compile(
    r"(?:\b(?:street|st|road|rd|avenue|ave|lane|ln|boulevard|blvd|drive|dr|court|ct|way|terrace|close|place|pl|square|sq|crescent|row|parkway|pkwy|highway|hwy|str|weg|allee|platz|gasse|ring|ufer|rue|chemin|calle|avenida|plaza|paseo|via|viale|piazza)\b\.?|(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer))",
    re.I,
)

_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w+-][\w.+-]*(?:@|%40)(?:[\w-]+\.)+[A-Za-z]{2,}(?![\w-]|:[\w/~])"
    r"|(?<![\w.+%-])[\w+-][\w.+-]* ?[\[(<{] ?at ?[\])>}] ?(?:[\w-]+(?:\.| ?[\[(]dot[\])] ?))+[A-Za-z]{2,}(?![\w-])",
    re.I,
)
_AT = re.compile(r"(.*?)(@|%40| ?[\[(<{] ?at ?[\])>}] ?)(.*)", re.S)
_DOT = re.compile(r" ?[\[(]dot[\])] ?")
#: What a street is followed by in a whole address: a flat, a place or a postal code.
_PLACE = re.compile(r",|\d[a-z]? .*\d|\b(?:Apt|Apartment|Unit|Suite|Ste|Flat)\b")
_REMOTE = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w.-]+:[\w/~][^\s\"]*")
_ID = re.compile(r"(?<![\w.-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9}[A-Z]?)(?![\w-]|\.\d)")
_PHONE = re.compile(r"(?<![\w.+/:-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d+(?:[ .-]\d+){0,5}(?![\w-]|[.:/]\d)")


def _address(rx, upper: str):
    cap = rf"{upper}[\w'’-]*[^\W\d_]"
    return rx.compile(
        rf"(?<![\w.-])(?<!\d:)\d{{1,5}}[a-z]?(?: {cap}\.?){{1,4}}(?:,? (?:Apt|Apartment|Unit|Suite|Ste|Flat|No|#)\.? ?\d+\w?)?(?:, {cap}(?: {cap})?)?(?:,? \d{{4,5}}(?![\w.]))?"
        rf"|(?<![\w.-])(?:{cap}\.? ){{1,3}}\d{{1,4}}[a-z]?(?![\w.]\w)(?:, \d{{4,5}} {cap}(?: {cap})?)?"
    )


def _names(rx, upper: str, lower: str):
    word, capitals = rf"{upper}(?:{lower}|['’])+(?:-{upper}{lower}+)?", rf"{upper}{{2,}}"
    return (
        ("pair", rx.compile(rf"(?<![\w.@-])({word}|{capitals}) ({word}|{capitals})(?![\w@])")),
        ("inverted", rx.compile(rf"(?<![\w.@-])({word}|{capitals}), ({word}|{capitals})(?![\w@])")),
        ("initial", rx.compile(rf"(?<![\w.@-])({upper}\.) ?({word}|{capitals})(?![\w@])")),
        ("camel", rx.compile(rf"(?<=[/\\])({upper}{lower}{{2,}})({upper}{lower}{{2,}})(?=[/\\])")),
        ("handle", re.compile(r"(?:(?<=[/\\(@~])|(?<=^))([^\W\d_]{2,})[._-]([^\W\d_]{2,})(?=[/\\):,\s]|$)")),
    )


# a text of ASCII alone needs no tables of scripts
_ASCII_ADDRESS, _ASCII_NAMES = _address(re, "[A-Z]"), _names(re, "[A-Z]", "[a-z]")
_ANY_ADDRESS = _address(regex, r"\p{Lu}")
_ANY_NAMES = (
    *_names(regex, r"\p{Lu}", r"[\p{Ll}\p{M}]"),
    # scripts without capitals: two words in a row, or a short run of signs that stands alone
    ("uncased", regex.compile(r"(?<![\p{L}\p{M}])(\p{Lo}[\p{Lo}\p{M}]+)[ ·・](\p{Lo}[\p{Lo}\p{M}]+)(?![\p{L}\p{M}])")),
    ("run", regex.compile(r"(?<![\p{L}\p{M}])([\p{Han}\p{Hangul}])([\p{Han}\p{Hangul}]{1,3})(?![\p{L}\p{M}])")),
)
#: What a text must have for a shape to occur in it.
_NEEDS = {"inverted": ", ", "initial": "."}
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_STOP = {".", "?", "!", "\n"}


def leaves(text: str) -> tuple[object, list[str]]:
    """What rebuild() needs, and the strings to look at: those of a JSON text, else the text between its escape sequences."""
    if text[:1] in "[{":
        try:
            value = json.loads(text)
            found: list[str] = []
            _walk(value, found.append)
            return value, found
        except (ValueError, RecursionError):
            parts = re.split(r"(\\u[0-9a-fA-F]{4}|\\[nrtbf\"\\/])", text)
            return parts, parts[0::2]
    return None, [text]


def _walk(value, take: Callable[[str], object]) -> None:
    work = [value]
    while work:
        v = work.pop()
        if isinstance(v, str):
            take(v)
        elif isinstance(v, dict):
            work.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            work.extend(reversed(v))


def rebuild(text: str, form: object, new: list[str]) -> str:
    """The text with its leaves replaced; JSON keeps its structure and its spacing after commas and colons."""
    if form is None:
        return new[0]
    if isinstance(form, list) and text[:1] in "[{" and all(isinstance(p, str) for p in form) and "".join(form) == text:
        form[0::2] = new
        return "".join(form)
    it = iter(new)

    def put(v):
        if isinstance(v, str):
            return next(it)
        if isinstance(v, dict):
            return {k: put(x) for k, x in v.items()}
        return [put(x) for x in v] if isinstance(v, list) else v

    wide = '", "' in text or '": ' in text
    return json.dumps(put(form), ensure_ascii="\\u" in text, separators=(", ", ": ") if wide else (",", ":"))


def _context(text: str, a: int, b: int) -> list[str]:
    """Patterns of the words around a candidate, within its sentence."""
    left = _TOKEN.findall(text[max(0, a - 40) : a].lower())[-2:]
    if "\n" in text[max(0, a - 3) : a]:
        left = []
    if left and left[0] in _STOP:
        left = left[1:]
    if left and left[-1] in _STOP:
        left = []
    right = _TOKEN.findall(text[b : b + 40].split("\n", 1)[0])[:2]
    lower = [t for t in right if t.isalpha() and t == t.lower()]
    out = []
    if left:
        out.append("L " + " ".join(["^", *left][-2:]) if left[-1].isalpha() else "L " + " ".join(left))
    if len(right) == 2 and len(lower) == 2:
        out.append("R " + " ".join(right))
    if left and lower and right[0] == lower[0] and left[-1].isalpha():
        out.append(f"B {left[-1]} {right[0]}")
    return [p for p in out if any(c.isalpha() for c in p[2:])]


def candidates(text: str) -> list[tuple[int, int, str, str, bool, list[str]]]:
    """(from, to, kind, instance, seed, patterns) of all candidates of a text; those of one kind may overlap."""
    out = []
    plain = text.isascii()
    taken = [m.span() for m in _REMOTE.finditer(text)] if "@" in text else []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    if "@" in text or "%40" in text or " at" in text or "(at" in text or "[at" in text:
        for m in _EMAIL.finditer(text):
            if free(*m.span()):
                taken.append(m.span())
                a, b = m.span()
                local, sign, host = _AT.match(m.group().lower()).groups()
                host = _DOT.sub(".", host)
                own = f"{local}@{host}"
                out.append((a, b, "email", own, False, [f"F {sign.strip()}", f"D {'.'.join(host.split('.')[-2:])}", *_context(text, a, b)]))
    if _DIGIT.search(text):
        for m in _ID.finditer(text):
            a, b = m.span()
            if free(a, b):
                taken.append((a, b))
                form = re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", m.group()))
                near = _ID_WORDS.search(text[max(0, a - 32) : a]) or _ID_WORDS.search(text[b : b + 12])
                out.append((a, b, "id_number", re.sub(r"\W", "", m.group()), bool(near), [f"F {form}", *_context(text, a, b)]))
        for m in (_ASCII_ADDRESS if plain else _ANY_ADDRESS).finditer(text):
            a, b = m.span()
            if free(a, b):
                street = [x.group().lower().strip(".") for x in _STREET.finditer(m.group())]
                whole = bool(_PLACE.search(m.group()))
                if street or "," in m.group():
                    taken.append((a, b))
                out.append((a, b, "address", re.sub(r"\W+", " ", m.group().lower()), bool(street) and whole, [*(f"S {x}" for x in street), *_context(text, a, b)]))
        for m in _PHONE.finditer(text):
            a, b = m.span()
            s = m.group()
            n = sum(c.isdigit() for c in s)
            if not 9 <= n <= 15 or not free(a, b) or re.fullmatch(r"\d{4}[-. ]\d\d[-. ]\d\d.*|\d+\.\d+|\d{1,3}(?:\.\d{1,3}){3}", s):
                continue
            seed = s[0] == "+" or bool(re.fullmatch(r"\(\d{3}\) ?\d{3}[ -]\d{4}", s)) or not s.isdigit() and bool(_PHONE_WORDS.search(text[max(0, a - 14) : a]))
            form = [f"F {re.sub(r'\d', '0', s)}", *(["P +"] if s[0] == "+" else [])] if not s.isdigit() else []
            out.append((a, b, "phone", re.sub(r"\D", "", s), seed, [*form, *_context(text, a, b)]))
    for shape, rx in _ASCII_NAMES if plain else _ANY_NAMES:
        if _NEEDS.get(shape, "") not in text:
            continue
        at = 0
        while m := rx.search(text, at):
            a, b = m.span()
            at = m.start(2) if m.start(2) > a else b  # a second word may begin the next candidate
            if free(a, b):
                one, two = m.group(1).lower(), m.group(2).lower()
                words = [f"W {w}" for w in (one, two) if w[-1] != "."]
                out.append((a, b, "name", " ".join(sorted((one, two))), False, [*words, *_context(text, a, b)]))
    return out


_CAND = "uuid string, field string, digest binary, leaf int, a int, b int, kind string, instance string, seed boolean, patterns array<string>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()))
    names = [x.split()[0] for x in _CAND.split(", ")]
    for b in batches:
        rows = []
        for uuid, field, digest, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            for n, leaf in enumerate(leaves(text)[1]):
                rows.extend((uuid, field, digest, n, *c) for c in candidates(leaf))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def fields(lines: DataFrame) -> DataFrame:
    """(uuid, field, digest, text): the texts of the lines; lines stored again give theirs again, with the same digest."""
    parts = F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in (("message.content", "message.content"), ("toolUseResult", "toolUseResult"), ("cwd", "cwd"))))
    rows = lines.select("uuid", F.explode(parts).alias("x")).select("uuid", "x.field", "x.text").filter("uuid IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return rows.select("uuid", "field", F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def _people(people: DataFrame) -> DataFrame:
    """(kind, instance, seed, pattern) of what is known of persons: their names, and their addresses where people has the column email."""
    parts = F.split(F.lower(F.regexp_replace(F.trim("person_name"), r"\s+", " ")), " ")
    ends = F.array_sort(F.array(F.element_at(parts, 1), F.element_at(parts, -1)))
    persons = people.filter("person_name IS NOT NULL").select(parts.alias("p"), ends.alias("e")).filter(F.size("p") > 1)
    known = persons.select(F.lit("name").alias("kind"), F.array_join("e", " ").alias("instance"), F.lit(True).alias("seed"), F.explode(F.transform("e", lambda w: F.concat(F.lit("W "), w))).alias("pattern"))
    if "email" in people.columns:
        own = F.lower(F.trim("email"))
        host = F.element_at(F.split(own, "@"), -1)
        end = F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, 2), ".")
        end = F.array_join(F.reverse(F.split(end, r"\.")), ".")
        known = known.unionByName(people.filter(own.contains("@")).select(F.lit("email").alias("kind"), own.alias("instance"), F.lit(True).alias("seed"), F.explode(F.array(F.lit("F @"), F.concat(F.lit("D "), end))).alias("pattern")))
    return known


def _usual(p: DataFrame) -> DataFrame:
    """(kind, usual): the share of known instances that is usual in contexts p (kind, pattern, word, n, k) with many of them, as the median over their known instances, to a quarter of a power of two."""
    many = p.filter(~F.col("word") & (F.col("k") >= MANY_KNOWN))
    return many.groupBy("kind").agg(F.pow(F.lit(2.0), F.percentile(F.floor(F.log2(F.col("k") / F.col("n")) * 4) / 4, F.lit(0.5), F.col("k"))).alias("usual"))


def known_instances(found: DataFrame, people: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(kind, instance): what the pattern-instance graph of the candidates accepts, starting from their seeds and people(person_name[, email]). Without rounds nothing is accepted.

    A pattern counts by its different instances, so repeated texts give it no weight. Where few of all items are known, contexts are good by the share that is usual, so that a seed list of fixed length serves texts of any size. A hot pattern's instances are split by salt where its verdict is joined to them.
    """
    e = found.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    rows = [(c[2], c[3], True, p) for x in EXAMPLES for c in candidates(x) if c[2] != "name" for p in c[5]]
    samples = found.sparkSession.createDataFrame(rows, "kind string, instance string, seed boolean, pattern string")
    edges = written(e.unionByName(_people(people)).unionByName(samples).groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed")), "pattern-graph")
    known = written(edges.groupBy("kind", "instance").agg(F.max("seed").alias("known"), F.lit(False).alias("accepted")), "pattern-known")
    links = edges.select("kind", "instance", "pattern", F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int").alias("salt"))
    word = F.col("pattern").startswith("W ")
    share = F.when(F.col("kind") == "email", EMAIL_SHARE).otherwise(GOOD_SHARE)
    for _ in range(rounds):
        p = links.join(known, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.count_if("known").alias("k"))
        p = written(p.withColumn("word", word).filter("k >= 1 OR word AND n >= 3"), "pattern-shares")
        p = p.join(F.broadcast(_usual(p)), "kind", "left")  # a row for each kind
        usual = (F.col("k") >= MANY_KNOWN) & (F.col("k") >= share * F.col("usual") * F.col("n"))
        phrase = (F.col("k") >= LEAST_KNOWN) & (F.col("k") >= share * F.col("n")) | F.coalesce(usual, F.lit(False))
        good = F.when(F.col("word"), (F.col("k") >= 1) & (F.col("k") >= 0.5 * F.col("n"))).otherwise(phrase)
        bad = F.col("word") & (F.col("n") >= 3) & (F.col("k") == 0)  # a word of many candidates, none of them known
        p = p.select("kind", "pattern", "word", good.alias("good"), bad.alias("bad")).filter("good OR bad")
        p = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        s = links.join(p, ["kind", "pattern", "salt"]).groupBy("kind", "instance").agg(F.bool_or(~F.col("word") & F.col("good")).alias("phrase"), F.bool_or(F.col("word") & F.col("good")).alias("word"), F.bool_or("bad").alias("bad"))
        now = F.coalesce(F.col("phrase") | F.col("word") & ~F.col("bad"), F.lit(False))
        known = written(known.join(s, ["kind", "instance"], "left").select("kind", "instance", (F.col("known") | now).alias("known"), now.alias("accepted")), "pattern-known")
    return known.filter("accepted").select("kind", "instance")


def _accepted(lines: DataFrame, people: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    texts = fields(lines)
    found = written(texts.mapInArrow(_extract, _CAND), "personal")
    ok = known_instances(found, people, rounds=rounds)
    return texts, found.join(ok, ["kind", "instance"], "left_semi").select(found.columns)


def personal_kinds(lines: DataFrame, people: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(uuid, field, kind): the fields of lines that hold an item of the kind; lines stored again count once.

    Null and empty fields hold nothing; rows with null uuid are left out. JSON is read through to its strings, other text is taken as it is.
    """
    return _accepted(lines, people, rounds)[1].select("uuid", "field", "kind").distinct()


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, items in zip(b.column("text").to_pylist(), b.column("items").to_pylist()):
            if not items:
                out.append(text)
                continue
            form, parts = leaves(text)
            new = list(parts)
            by: dict[int, list] = {}
            for x in items:
                by.setdefault(x["leaf"], []).append((x["a"], x["b"], x["kind"]))
            for n, spans in by.items():
                if n >= len(parts):
                    continue
                done, at = [], 0
                for a, z, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
                    if a >= at:
                        done += [parts[n][at:a], f"[{kind.upper()}]"]
                        at = z
                new[n] = "".join(done) + parts[n][at:]
            out.append(rebuild(text, form, new))
        yield pa.RecordBatch.from_arrays([b.column("uuid"), b.column("field"), pa.array(out, pa.string())], names=["uuid", "field", "text"])


def redacted(lines: DataFrame, people: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(uuid, field, text): every field of lines with its items replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME].

    Where items overlap, the one that begins first (then the longer) gives the placeholder. JSON texts stay JSON.
    """
    texts, sure = _accepted(lines, people, rounds)
    key = ["uuid", "field", "digest"]
    items = sure.groupBy(*key).agg(F.collect_set(F.struct("leaf", "a", "b", "kind")).alias("items"))  # at most a field's own items
    return texts.dropDuplicates(key).join(items, key, "left").mapInArrow(_redact, "uuid string, field string, text string")
