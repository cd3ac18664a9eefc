"""Personal data: keyed surrogates of the same type, gender, script and format, by DataFrame functions alone.

An entity is parted into units: fixed text, and words or numbers that change. A unit goes through a keyed permutation of
all strings of its format: every character goes to one of its own class (digits to digits, vowels to vowels), by shifts
that a keyed digest of the other characters gives. Three such steps over disjoint characters are a bijection, and the
last one always moves its character. Where some results mean another kind of thing (a reserved domain, a fictional
number, a common given name), the permutation is walked on until the result is none of them, which keeps it a bijection
of the rest. Common given names go to others of their gender. So equal entities get equal surrogates in all documents
(coreference), different ones never meet (distinctness), none stays as it is, and no table of entities is gathered,
shuffled or kept. collisions() checks that on the data.
"""

from __future__ import annotations

import hashlib
import unicodedata
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The session setting that holds the key; without it a key that everyone can read here is used, which hides nothing
#: from who knows it.
KEY_SETTING, OPEN_KEY = "spark.pairfield.pii.key", "pairfield-surrogates"

#: Common given names, which are found without a title and go to others of their list.
GIVEN = {
    "m": "James Robert Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Kevin Brian George Timothy Ronald "
    "Jason Edward Jeffrey Jacob Nicholas Jonathan Stephen Hans Klaus Wolfgang Jürgen Stefan Andreas Pierre François Philippe Jacques Carlos Javier Miguel Alejandro Fernando".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie "
    "Rebecca Sharon Laura Cynthia Kathleen Angela Shirley Ursula Monika Sabine Petra Heike Ingrid Sylvie Nathalie Isabelle Françoise Carmen Lucía Dolores Pilar Mercedes".split(),
}
_GIVEN = "|".join(f"{n}|{n.upper()}" for names in GIVEN.values() for n in names)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Letters that have classes; an initial; a word of a name, which may have marks, apostrophes and inner capitals.
_L = r"[\p{L}&&[\x{41}-\x{2dff}]]"
_LETTERS = rf"(?:{_L}\p{{M}}*+)"
_UPPER = r"[\p{Lu}&&[\x{41}-\x{2dff}]]"
_INITIAL, _WORD = rf"{_UPPER}\.", rf"(?:{_UPPER}['’])?+{_UPPER}\p{{M}}*+{_LETTERS}++(?:['’]{_UPPER}\p{{M}}*+{_LETTERS}++)*+"
_TITLE = (
    r"(?:Mr\.?|Mrs\.?|Ms\.?|Mx\.?|Miss|Dr\.|Prof\.|Professor|Sir|Dame|Herrn?|Frau|Monsieur|Madame|Mme|Mlle|M\.|Señora?|Señorita|Sra?\.|Srta\.|Signora?|Senhora?|"
    r"[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа|[Κκ]ύριος|[Κκ]υρία)"
)
_REST = rf"(?:[ -](?:{_WORD}|{_INITIAL}))*+"
#: Surnames after which a title is looked for in scripts without spaces.
_HAN, _HANGUL = "[王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭程曹袁邓鄧许許傅沈曾彭吕呂]", "[김이박최정강조윤장임한오서신권황안송류홍]"
#: What is detected, in order of precedence. Patterns of a type, as fixed formats. Each match has a character that can move.
PATTERNS = {
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|api_?key|access_?key|auth|token))\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_.~-]*+[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,}+[\"']?",
    "email": r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])",
    "phone": r"\+\d{1,3}[ -]?\(\d{2,4}\) ?\d{3,4}[ -]?\d{3,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "name": rf"(?![a-z0-9\s.,])(?:(?<!\p{{L}})(?:{_TITLE} )++(?:{_INITIAL}[ -]?)*+{_WORD}{_REST}|(?=[A-Z])(?<!\p{{L}})(?:{_GIVEN}) (?:{_INITIAL}[ -]?)*+{_WORD}{_REST}"
    r"|(?<!\p{L})(?:السيدة|السيد|الدكتورة|الدكتور) \p{IsArabic}++(?: \p{IsArabic}++)?+|(?<!\p{L})(?:श्रीमती|श्री|सुश्री) \p{IsDevanagari}++(?: \p{IsDevanagari}++)?+"
    rf"|{_HAN}[\x{{4e00}}-\x{{9fbf}}]{{1,2}}?(?=先生|女士|小姐|さん|様)|{_HANGUL}[\x{{ac00}}-\x{{d77f}}]{{1,2}}(?= ?씨| ?님))",
}
ANY = "|".join(PATTERNS.values())
#: A text without one of these has no entity; looked for first because it is cheap.
HINT = (
    r"[0-9@]|(?i:password|passwd|pwd|secret|key|auth|token)|(?![a-z\s.,])(?:AKIA|ASIA|M(?:r|rs|s|x|me|lle|iss|onsieur|adame)\b|M\.|Dr\.|Prof|Sir|Dame|Herr|Frau|Señor|Sra?\.|Srta|"
    rf"Signor|Senhor|[Гг]-н|[Гг]-жа|[Гг]оспо|[Κκ]ύρι|السيد|الدكتور|श्री|सुश्री|先生|女士|小姐|さん|様|씨|님|(?=[A-Z])(?:{_GIVEN}))"
)
#: Domains that are nobody's, and the ending of fictional numbers; they stay, and nothing else becomes one.
RESERVED, FICTIONAL = r"(?i)(^|\.)(example\.(com|org|net)|example|test|invalid|localhost)$", r"\b555-\d{4}$"
#: Rounds of walking; each is needed with a chance of less than one in a hundred.
WALKS = 24

#: Classes of characters that go to each other. Fixed values.
_CODE = ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
_VOWELS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâáäãåéèêëíìîïóòôöõøúùûüýÿ", "ÀÂÁÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÝ", "çñ", "ÇÑ", "ªºµ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)


def _scripts() -> list[str]:
    """All other letters below U+2E00, by case and blocks of 64; a lone letter joins the class before it."""
    known, out = set("".join(_VOWELS)), {}
    for c in map(chr, range(0x41, 0x2E00)):
        kind = unicodedata.category(c)
        if kind[0] == "L" and c not in known:
            classes = out.setdefault(kind, [])
            if not classes or ord(classes[-1][0]) // 64 != ord(c) // 64:
                classes.append("")
            classes[-1] += c
    every = []
    for classes in out.values():
        joined: list[str] = []
        for letters in classes:
            if joined and (len(letters) == 1 or len(joined[-1]) == 1):
                joined[-1] += letters
            else:
                joined.append(letters)
        every += joined
    return [c for c in every if len(c) > 1]


#: Sets of classes: of codes, of numbers whose leading digits tell something, of names.
SETS = {"c": (*_CODE, "0123456789"), "d": (*_CODE, "01", "234567", "89"), "n": (*_VOWELS, *_scripts())}
ALPHABET = {s: "".join(classes) for s, classes in SETS.items()}
_FLAT = [(s, c) for s, classes in SETS.items() for c in classes]
_FIRST = 0x4E00
#: For each letter of an alphabet the number of its class; for each class its place in the alphabet and its size, in five digits.
_CLASS = {s: "".join(chr(_FIRST + i) * len(c) for i, (t, c) in enumerate(_FLAT) if t == s) for s in SETS}
_START = "".join(f"{ALPHABET[s].index(c):05d}" for s, c in _FLAT)
_SIZE = "".join(f"{len(c):05d}" for _, c in _FLAT)
#: Scripts in blocks of 64 letters that are classes by themselves; their starts are code points above this.
_BLOCKS, _POINT = ((0x4E00, 0x9FC0), (0xAC00, 0xD780)), 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_set(which: Column, texts: dict[str, str]) -> Column:
    return F.when(which == "c", texts["c"]).when(which == "d", texts["d"]).otherwise(texts["n"])


def _slot(c: Column, i: Column, n: Column, unit: Column) -> Column:
    """A character, the start and size of its class, and its place in it; size 0 if it stays."""
    at = F.instr(_by_set(unit["set"], ALPHABET), c)
    point = F.ascii(c)
    block = F.lit(False)
    for low, high in _BLOCKS:
        block = block | ((point >= low) & (point < high))
    stays = (i < unit["head"]) | (i >= n - unit["tail"])

    def known(at: Column) -> Column:
        number = (F.ascii(F.substr(_by_set(unit["set"], _CLASS), at, F.lit(1))) - _FIRST) * 5 + 1
        number = F.when(at > 0, number).otherwise(1)
        start, size = (F.substr(F.lit(x), number, F.lit(5)).cast("int") for x in (_START, _SIZE))
        start = F.when(at > 0, start).otherwise(_POINT + point - point % 64)
        size = F.when(stays, 0).when(at > 0, size).when(block, 64).otherwise(0)
        return F.struct(c.alias("c"), start.alias("start"), size.alias("size"), F.when(at > 0, at - 1 - start).otherwise(point % 64).alias("x"))

    return _let(at, known)


def _letter(slot: Column, x: Column, which: Column) -> Column:
    point = F.decode(F.unhex(F.lpad(F.hex((slot["start"] - _POINT + x).cast("long")), 8, "0")), "UTF-32")
    moved = F.when(slot["start"] < _POINT, F.substr(_by_set(which, ALPHABET), slot["start"] + x + 1, F.lit(1))).otherwise(point)
    return F.when(slot["size"] > 0, moved).otherwise(slot["c"])


def permuted(key: str, unit: Column) -> Column:
    """The keyed permutation of unit.t within its format; so many characters at its ends (head, tail) stay as they are.

    In steps 1 and 2 the characters at odd and even places move, but for the first that can; in step 3 that one moves.
    """

    def of(slots: Column) -> Column:
        can = F.transform(slots, lambda s: s["size"] > 0)
        first = F.array_position(can, F.lit(True)).cast("int") - 1

        def step(xs: Column, k: Column) -> Column:
            mine = lambda i: F.when(k == 3, i == first).otherwise((i % 2 == k % 2) & (i != first))
            rest = F.transform(slots, lambda s, i: F.when(mine(i) & (s["size"] > 0), "").otherwise(_letter(s, F.get(xs, i), unit["set"])))
            seed = F.concat(F.lit(f"{key}|"), k.cast("string"), F.lit("|"), unit["tweak"], F.lit("|"), F.lower(F.array_join(rest, "")))

            def moved(digest: Column) -> Column:
                draw = lambda i: F.conv(F.substr(digest, (i * 3) % 58 + 1, F.lit(6)), 16, 10).cast("long") + i

                def one(x: Column, i: Column) -> Column:
                    size = F.get(slots, i)["size"]
                    by = F.when(k == 3, draw(i) % F.greatest(size - 1, F.lit(1)) + 1).otherwise(draw(i))
                    return F.when(mine(i) & (size > 0), (x + by) % F.greatest(size, F.lit(1))).otherwise(x).cast("int")

                return F.transform(xs, one)

            return _let(F.sha2(seed, 256), moved)

        start = F.transform(slots, lambda s: s["x"].cast("int"))
        return _let(F.aggregate(F.array(*map(F.lit, (1, 2, 3))), start, step), lambda xs: F.array_join(F.transform(slots, lambda s, i: _letter(s, F.get(xs, i), unit["set"])), ""))

    chars = F.regexp_extract_all(unit["t"], F.lit(r"(?s)."), F.lit(0))
    return _let(_let(chars, lambda cs: F.transform(cs, lambda c, i: _slot(c, i, F.size(cs), unit))), of)


def _walked(key: str, unit: Column) -> Column:
    """The unit's surrogate; walked on while it is what unit.avoid names."""
    if_domain = (unit["avoid"] == 1) & unit["t"].isNotNull()

    def bad(t: Column) -> Column:
        return F.when(if_domain, t.rlike(RESERVED)).when(unit["avoid"] == 2, t.rlike(FICTIONAL)).when(unit["avoid"] == 3, t.rlike(f"^(?:{_GIVEN})$")).otherwise(False)

    def go(acc: Column, _: Column) -> Column:
        now = F.struct(acc["t"].alias("t"), *[unit[f].alias(f) for f in ("set", "tweak", "head", "tail")])
        return F.when(acc["done"], acc).otherwise(_let(_let(now, lambda u: permuted(key, u)), lambda t: F.struct(t.alias("t"), (~bad(t)).alias("done"))))

    zero = F.struct(unit["t"].alias("t"), (unit["set"] == "").alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.when((unit["set"] == "") | (unit["avoid"] == 0), 1).otherwise(WALKS)), zero, go)["t"]


def _unit(t: Column, which: Column | str = "", tweak: Column | str = "", head: Column | int = 0, tail: Column | int = 0, avoid: Column | int = 0) -> Column:
    """Text with the set of its classes; with none it is fixed."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {"t": t, "set": lit(which), "tweak": lit(tweak), "head": lit(head), "tail": lit(tail), "avoid": lit(avoid)}
    return F.struct(*[v.cast("string" if k in ("t", "set", "tweak") else "int").alias(k) for k, v in fields.items()])


def _ip(key: str, e: Column) -> Column:
    def mixed(o: Column) -> Column:
        left, right = F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3))
        draw = lambda step, half: F.conv(F.substr(F.sha2(F.concat(F.lit(f"{key}|ip|{step}|"), half.cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")

        def last(r: Column) -> Column:
            new = left.cast("long").bitwiseXOR(draw(2, r) % 65535 + 1)
            quad = [F.floor(new / 256), new % 256, F.floor(r / 256), r % 256]
            return F.concat_ws(".", *[q.cast("long").cast("string") for q in quad])

        return _let(right.cast("long").bitwiseXOR(draw(1, left) % 65536), last)

    return _let(F.transform(F.split(e, r"\."), lambda x: x.cast("int")), mixed)


def _luhn(s: Column) -> Column:
    """The check digit of a string's digits."""
    payload = F.transform(F.regexp_extract_all(s, F.lit(r"\d"), F.lit(0)), lambda x: x.cast("int"))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = lambda p: F.transform(p, lambda d, i: F.when((F.size(p) - 1 - i) % 2 == 0, doubled(d)).otherwise(d))
    return (10 - F.aggregate(_let(payload, each), F.lit(0), lambda a, x: a + x) % 10) % 10


def _card(key: str, e: Column) -> list[Column]:
    """Issuer digit and separators stay; the check digit, which surrogate() adds, is as right or wrong as it was."""
    return [_unit(F.substr(e, F.lit(1), F.length(e) - 1), "c", "card", 1)]


def _email(key: str, e: Column) -> list[Column]:
    """Reserved domains stay, and the last part of others."""
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(domain, ".", -1)
    return [
        _unit(local, "c", F.concat(F.lit("email"), F.lower(domain))),
        _unit(F.lit("@")),
        _unit(domain, F.when(domain.rlike(RESERVED), "").otherwise("c"), "domain", 0, F.length(top) + 1, 1),
    ]


def _phone(key: str, e: Column) -> list[Column]:
    """Country prefix and a fictional exchange 555 stay; ### stands for that one, see surrogate()."""
    country = F.regexp_extract(e, r"^(?:\+\d{1,3}(?=\D))?", 0)
    rest = F.substr(e, F.length(country) + 1, F.length(e))
    veiled = F.regexp_replace(rest, r"\b555(-\d{4})$", "###$1")
    return [_unit(country), _unit(veiled, "d", F.concat(F.lit("phone"), country), 0, 0, F.when(veiled == rest, 2).otherwise(0))]


def _secret(key: str, e: Column) -> list[Column]:
    head = F.regexp_extract(e, r"^(?s).*?[=:]\s*[\"']?", 0)
    value = F.regexp_extract(F.substr(e, F.length(head) + 1, F.length(e)), r"^[^\"']*", 0)
    return [_unit(head), _unit(value, "c", "secret"), _unit(F.substr(e, F.length(head) + F.length(value) + 1, F.length(e)))]


def given_names(key: str) -> str:
    """All common given names with those that replace them, as |name:other|; a cycle through each list in a keyed order."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        pairs += [f"{a}:{b}|{a.upper()}:{b.upper()}" for a, b in zip(order, [*order[1:], order[0]], strict=True)]
    return f"|{'|'.join(pairs)}|"


def _name(key: str, e: Column) -> Column:
    """Titles, which tell the gender, stay; each word or initial maps by itself, given names within their gender."""
    titles = F.regexp_extract(e, rf"^(?:(?:{_TITLE}|السيدة|السيد|الدكتورة|الدكتور|श्रीमती|श्री|सुश्री) )*+", 0)
    parts = F.regexp_extract_all(F.substr(e, F.length(titles) + 1, F.length(e)), F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), F.lit(0))

    def part(p: Column) -> Column:
        pairs = F.lit(given_names(key))
        other = F.substring_index(F.call_function("substring_index", pairs, F.concat(F.lit("|"), p, F.lit(":")), F.lit(-1)), "|", 1)
        return F.when(p.rlike(f"^(?:{_GIVEN})$"), _unit(other)).otherwise(_unit(p, "n", "name", 0, 0, 3))

    return F.concat(F.array(_unit(titles)), F.transform(parts, part))


def kind_of(entity: Column) -> Column:
    """The type of a match, by the patterns in their order."""
    out = None
    for kind, pattern in PATTERNS.items():
        hit = entity.rlike(f"^(?:{pattern})$") if kind != "name" else F.lit(True)
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out


def surrogate(entity: Column, key: str = OPEN_KEY) -> Column:
    """What replaces a match of ANY. All types share one expression of the permutation."""
    units = {"secret": _secret, "email": _email, "card": _card, "phone": _phone}

    def parted(kind: Column) -> Column:
        out = F.when(kind == "ip", F.array(_unit(_ip(key, entity)))).when(kind == "ssn", F.array(_unit(entity, "d", "ssn"))).when(kind == "key", F.array(_unit(entity, "d", "key", 4)))
        for name, parts in units.items():
            out = out.when(kind == name, F.array(*parts(key, entity)))
        return F.struct(kind.alias("kind"), out.otherwise(_name(key, entity)).alias("units"))

    def joined(p: Column) -> Column:
        made = F.array_join(F.transform(p["units"], lambda u: _walked(key, u)), "")
        body, check = F.substr(entity, F.lit(1), F.length(entity) - 1), F.substr(entity, F.length(entity), F.lit(1)).cast("int")
        card = lambda b: F.concat(b, ((_luhn(b) + check - _luhn(body) + 10) % 10).cast("string"))
        return _let(made, lambda b: F.when(p["kind"] == "card", card(b)).when(p["kind"] == "phone", F.replace(b, F.lit("###"), F.lit("555"))).otherwise(b))

    return _let(_let(kind_of(entity), parted), joined)


def found(text: Column) -> Column:
    """The entities of a text, in order; none of a null text."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def surrogates(docs: DataFrame, key: str | None = None, text: str = "text", entities: str | None = None) -> DataFrame:
    """docs with all columns, in which the text has surrogates for its personal data; everything else in it stays.

    key: from the session's setting KEY_SETTING if not given. entities: a column to add, which holds what was replaced.
    Null and empty texts stay so; repeated rows and equal entities change alike; an empty table gives an empty result.
    Each row is worked out by itself: no shuffle, no join, no limit on a text's length or entities.
    """
    key, t = _key(docs.sparkSession, key), F.col(f"`{text}`")
    e, columns = entities or "__entities", [F.col(f"`{c}`") for c in docs.columns if c != entities]
    made = F.array_join(F.zip_with(F.split(t, ANY, -1), F.transform(F.col(e), lambda x: surrogate(x, key)), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    rows = docs.select(*columns, found(t).alias(e)).withColumn(text, F.when(F.size(e) > 0, made).otherwise(t))
    return rows if entities else rows.drop(e)


def _key(spark: SparkSession, key: str | None) -> str:
    return key if key is not None else spark.conf.get(KEY_SETTING, OPEN_KEY)


def entities(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """(kind, entity, surrogate): the distinct entities of all documents."""
    each = docs.select(F.explode(found(F.col(f"`{text}`"))).alias("entity")).distinct()
    return each.select(kind_of(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), _key(docs.sparkSession, key)).alias("surrogate"))


def collisions(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity, or for their own entity; there are none if all is well."""
    shared = entities(docs, key, text).groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    return shared.filter((F.col("n") > 1) | (F.col("surrogate") == F.col("entity")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates, how many entities each had, and whether distinctness held for all of the corpus.

    A collision, which the permutations exclude, would be told in that column and a warning; it doesn't stop the others.
    """
    docs = table(spark, sf_dir, "documents")
    whole = not collisions(docs).limit(1).count()
    if not whole:
        warnings.warn("surrogates collide: see pii.collisions()", stacklevel=2)
    rows = surrogates(docs, entities="entities")
    return rows.withColumn("n_entities", F.size("entities").cast("long")).withColumn("distinct", F.lit(whole)).drop("entities")
