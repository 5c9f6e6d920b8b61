"""Scalar, array and vector functions as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as text methods know it: controls, separators and the next-line character.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(c: Column) -> Column:
    """case folded, runs of white space as one space, none at the ends."""
    folded = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def is_unknown(c: Column, mode: str = "contains") -> Column:
    """the four ways of telling a variable from a label."""
    return {"contains": c.contains("UNKNOWN"), "prefix": c.startswith("UNKNOWN"), "prefix_upper": F.upper(c).startswith("UNKNOWN"), "prefix_lower": F.lower(c).startswith("unknown")}[mode]


def unknown_type(c: Column) -> Column:
    """the words of a variable without its first UNKNOWN and without a number at the end; empty where nothing is left."""
    at = F.instr(c, "UNKNOWN")
    rest = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 7, F.length(c)))).otherwise(c)
    words = F.filter(F.split(rest, SPACE), lambda w: w != "")
    return let(words, lambda w: F.array_join(F.when((F.size(w) > 0) & F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")).rlike(r"^\p{Nd}+$"), F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1))).otherwise(w), " "))


#: A type by its other words.
TYPE_ALIASES = {"film": "movie", "films": "movie", "movies": "movie", "person": "actor", "people": "actor", "actors": "actor"}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small table, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def canonical_type(c: Column) -> Column:
    """The canonical name of a type label."""
    name = normalize_text(c)
    return F.coalesce(lookup(name, TYPE_ALIASES), name)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a UTF-8 text from built-in expressions."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    hashed = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(hashed)), 256)


def projection_64(encoded: Column) -> Column:
    """the first 64 bits of a hexadecimal id, as text."""
    return F.substring(encoded, 1, 16)


def limbs(encoded: Column) -> Column:
    """a 128-bit id as four 32-bit numbers."""
    return F.array(*(F.conv(F.substring(encoded, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def _none() -> Column:
    return F.array().cast("array<string>")


def _prefixed(prefix: str, words: Column) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(prefix), t))


def bigrams(words: Column, prefix: str = "bigram:") -> Column:
    """prefix + left:right for every two neighbours."""
    rest = F.greatest(F.lit(0), F.size(words) - 1)
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(F.lit(prefix), a, F.lit(":"), b))).otherwise(_none())


#: The words that stand for a relation, by alias.
RELATION_ALIASES = {
    "actor": "actor actors acted acting appear appeared appears cast star stars starred",
    "director": "direct directed director directors",
    "writer": "write writes written writer writers screenwriter",
    "genre": "genre genres type types",
    "language": "language languages",
    "release": "release released year date",
    "tag": "tag tags",
}
_ALIAS_OF = {word: alias for alias, words in RELATION_ALIASES.items() for word in words.split()}


def relation_alias_buckets(c: Column) -> Column:
    """path buckets of a dotted relation, then tokens, aliases of tokens, and bigrams; each once, in this order."""
    raw = normalize_text(c)
    part = lambda i: F.try_element_at(F.split(raw, "[.]"), F.lit(i))
    size = F.size(F.split(raw, "[.]"))
    two = F.array(F.concat(F.lit("fb:path:"), raw), F.concat(F.lit("fb:domain:"), part(1)), F.concat(F.lit("fb:type:"), part(1), F.lit("."), part(2)))
    three = F.array(F.concat(F.lit("fb:property:"), part(-1)), F.concat(F.lit("fb:type_property:"), part(-2), F.lit("."), part(-1)))
    dotted = F.when(raw.rlike(r"^[a-z0-9_]+([.][a-z0-9_]+)+$"), F.when(size >= 3, F.concat(two, three)).otherwise(two)).otherwise(_none())
    words = F.regexp_extract_all(F.translate(raw, "_.", "  "), F.lit("([a-z0-9]+)"), 1)
    aliases = F.filter(F.transform(words, lambda t: lookup(t, _ALIAS_OF)), lambda a: a.isNotNull())
    return F.array_distinct(F.concat(dotted, _prefixed("tok:", words), _prefixed("alias:", aliases), bigrams(words)))


#: Articles that entity buckets leave out.
ARTICLES = ("a", "an", "the")


def entity_alias_buckets(c: Column) -> Column:
    """tokens without articles, and bigrams, sorted."""
    words = F.filter(tokens(F.replace(normalize_text(c), F.lit("_"), F.lit(" "))), lambda t: ~t.isin(*ARTICLES))
    return F.array_sort(F.array_distinct(F.concat(_prefixed("entity_tok:", words), bigrams(words, "entity_bigram:"))))


def lsh_buckets(c: Column, dims: int = 128) -> Column:
    """The bands of a label's embedding."""
    return let(hash_embedding(c, dims), lambda v: simhash_bands(v, dims))


def relation_buckets(c: Column, mode: str = "alias", dims: int = 128) -> Column:
    """alias, lsh, or hybrid: both, aliases first."""
    if mode not in ("alias", "lsh", "hybrid"):
        raise ValueError(f"unknown bucket mode: {mode}")
    if mode == "alias":
        return relation_alias_buckets(c)
    return lsh_buckets(c, dims) if mode == "lsh" else F.array_distinct(F.concat(relation_alias_buckets(c), lsh_buckets(c, dims)))


def entity_buckets(c: Column, mode: str = "alias", dims: int = 128) -> Column:
    """F10 for entities; sorted where the two kinds are mixed."""
    if mode not in ("alias", "lsh", "hybrid"):
        raise ValueError(f"unknown bucket mode: {mode}")
    if mode == "alias":
        return entity_alias_buckets(c)
    lsh = _prefixed("entity_", lsh_buckets(c, dims))
    return lsh if mode == "lsh" else F.array_sort(F.array_distinct(F.concat(entity_alias_buckets(c), lsh)))


#: Words that tell nothing about a relation.
LOW_VALUE = "a an and are as by did do does for in is of the to was were what which who".split()


def query_buckets(buckets: Column, limit: int) -> Column:
    """at most ``limit`` buckets: aliases, tokens, bigrams (both without words of low value), LSH bands, then all others; each kind sorted."""
    kind = lambda b: F.substring_index(b, ":", 1)
    low = lambda b: F.arrays_overlap(F.slice(F.split(b, ":"), 2, 2), F.array(*map(F.lit, LOW_VALUE)))
    rank = lambda b: (
        F.when(kind(b) == "alias", "0").when((kind(b) == "tok") & ~low(b), "1").when((kind(b) == "bigram") & ~low(b), "2").when(kind(b) == "lsh", "3").otherwise("4")
    )
    ordered = F.array_sort(F.transform(F.array_distinct(buckets), lambda b: F.struct(rank(b).alias("r"), b.alias("b"))))
    return F.slice(F.transform(ordered, lambda x: x["b"]), 1, limit)


def l2_distance(a: Column, b: Column) -> Column:
    """F9."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def hash_embedding(c: Column, dims: int = 128) -> Column:
    """words and character trigrams of the joined words, hashed with a sign into ``dims`` places, of unit length. A text without
    words has the one feature ``empty``. Each feature is hashed once and added to one place."""
    words = tokens(F.replace(normalize_text(c), F.lit("_"), F.lit(" ")))
    joined = F.array_join(words, "")
    grams = F.when(F.length(joined) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(joined) - 2)), lambda i: F.concat(F.lit("tri:"), F.substring(joined, i, F.lit(3))))).otherwise(_none())
    features = F.when(F.size(words) > 0, F.concat(_prefixed("tok:", words), grams)).otherwise(F.array(F.lit("empty")))
    hashed = F.transform(features, lambda f: F.sha2(f, 256))
    place = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    signed = F.transform(hashed, lambda h: F.struct(place(h).alias("at"), sign(h).alias("by")))
    zeros = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(signed, zeros, lambda v, f: F.transform(v, lambda x, i: F.when(i == f["at"], x + f["by"]).otherwise(x)))
    unit = lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return let(total, unit)


def sign_matrix(bits: int, dims: int, seed: str) -> list[list[float]]:
    return [[1.0 if hashlib.sha256(f"{seed}:{b}:{i}".encode()).digest()[0] & 1 else -1.0 for i in range(dims)] for b in range(bits)]


def simhash_bands(v: Column, dims: int, bits: int = 16, bands: int = 4, seed: str = "lsh") -> Column:
    """F8: sign bits of random +-1 projections, cut into bands ``lsh:band:bits``."""
    rows = sign_matrix(bits, dims, seed)
    bit = [F.when(F.aggregate(F.zip_with(v, F.array(*map(F.lit, r)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x) >= 0, "1").otherwise("0") for r in rows]
    per = bits // bands
    return F.array(*(F.concat(F.lit(f"lsh:{b}:"), *bit[b * per : (b + 1) * per]) for b in range(bands)))


def reuses_node(path: Column) -> Column:
    """F24."""
    return F.size(F.array_distinct(path)) < F.size(path)


#: The multiplier of the bucket hash and the width of its words.
MULTIPLIER, WORD_BITS = 0x9E3779B97F4A7C15, 64


def key_tag(entity: Column, relation: Column, relations: int) -> Column:
    """the dense address of (entity from 0, relation from 1), plus one; a relation out of range fails."""
    ok = (relation >= 1) & (relation <= relations) & (entity >= 0)
    return F.when(ok, entity.cast("long") * relations + relation).otherwise(F.raise_error(F.lit("a key is out of range")).cast("long"))


def bucket_of(tag: Column, buckets: int) -> Column:
    """the top bits of tag * MULTIPLIER modulo 2^64. ``buckets`` is a power of two; a tag has 40 bits at most."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    if buckets == 1:
        return F.lit(0).cast("long")
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    word = (tag.cast("decimal(13,0)") * number(MULTIPLIER)) % number(1 << WORD_BITS)
    low = word % number((1 << WORD_BITS) // buckets)
    top = ((word - low) / number((1 << WORD_BITS) // buckets)).cast("long")
    return F.when((tag >= 0) & (tag < (1 << 40)), top).otherwise(F.raise_error(F.lit("a tag has over 40 bits")).cast("long"))


def pack_descriptor(base: Column, count: Column, base_bits: int) -> Column:
    """where a key's pages begin and how many there are, as one number."""
    return base.bitwiseOR(F.shiftleft(count.cast("long"), base_bits))


def unpack_descriptor(value: Column, base_bits: int) -> tuple[Column, Column]:
    return value.bitwiseAND(F.lit((1 << base_bits) - 1)), F.shiftright(value, base_bits)


def evidence_contains(evidence_json: Column, answers: Column) -> Column:
    """some answer is a substring of the evidence text, case folded."""
    return F.exists(answers, lambda g: F.lower(evidence_json).contains(F.lower(g)))


#: Phrases of a question that name a relation shared by two works.
SHARED_PHRASES = {
    "starred_actors": ("share actors", "same actor", "same movie", "also appear", "co-star", "acted together", "starred together"),
    "directed_by": ("share directors", "same director", "also directed", "co-director", "co-directed", "also the director", "directed films together", "directed movies together"),
    "written_by": ("share writers", "same screenwriter", "share the screenwriter", "also wrote", "co-wrote", "co-writer", "wrote movies together", "wrote films together", "written together"),
}
#: Phrases around the topic, which stands as [entity], that name the first relation; in this order.
FIRST_PHRASES = [
    ("written_by", ("[entity] written", "[entity] wrote", "[entity] screenwriter")),
    ("directed_by", ("[entity] directed",)),
    ("starred_actors", ("[entity] starred", "[entity] acted")),
    ("written_by", ("written by [entity]", "writer [entity]", "writer of [entity]")),
    ("directed_by", ("directed by [entity]", "director [entity]", "director of [entity]")),
    ("starred_actors", ("starred by [entity]", "acted by [entity]", "actor [entity]", "actor of [entity]")),
]
#: Phrases anywhere, and beginnings, that name the second relation; in this order.
SECOND_PHRASES = [
    ("in_language", ("language", "languages", "spoken"), ()),
    ("has_tags", ("tag", "tags"), ()),
    ("has_imdb_rating", ("imdb rating", "ratings", "rating"), ()),
    ("has_imdb_votes", ("imdb votes", "votes", "vote"), ()),
    ("has_genre", ("genre", "genres", "types", "type"), ()),
    ("release_year", ("release", "released", "when", "year", "years"), ()),
    ("directed_by", ("directed by who", "listed as director", "director is who"), ("who directed", "which person directed", "who are the directors")),
    ("written_by", ("written by who", "listed as screenwriter", "screenwriter is who"), ("who wrote", "which person wrote", "who are the writers")),
    ("starred_actors", ("starred", "actors", "actor", "person", "appeared", "who"), ()),
]


def template_relations(question: Column) -> Column:
    """the two relations that a question's phrases name, as a struct (relation_1, relation_2); null where it names none."""
    text = F.lower(question)
    masked = F.regexp_replace(text, r"\[[^\]]+\]", "[entity]")

    def first_of(choices: list[tuple[str, Column]]) -> Column:
        return F.coalesce(*(F.when(found, F.lit(name)) for name, found in choices))

    def some(where: Column, phrases: tuple[str, ...], begin: tuple[str, ...] = ()) -> Column:
        found = F.lit(False)
        for p in phrases:
            found = found | where.contains(p)
        for p in begin:
            found = found | where.startswith(p)
        return found

    shared = first_of([(name, some(text, phrases)) for name, phrases in SHARED_PHRASES.items()])
    first = first_of([(name, some(masked, phrases)) for name, phrases in FIRST_PHRASES])
    second = first_of([(name, some(text, phrases, begin)) for name, phrases, begin in SECOND_PHRASES])
    pair = lambda a, b: F.struct(a.alias("relation_1"), b.alias("relation_2"))
    return F.when(shared.isNotNull(), pair(shared, shared)).when(first.isNotNull() & second.isNotNull(), pair(first, second))
