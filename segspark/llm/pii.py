"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, IPv4 addresses, card numbers,
access keys, secrets after a label, and personal names. Each is replaced by a
surrogate of its own type and format that a keyed SHA-256 of its normal form
determines: letters stay letters, digits digits, separators and labels stay, a
card number stays valid, a name keeps its script and gender. Equal entities get
equal surrogates in all documents, however they are written; different ones get
different ones: all entities of the corpus are held against each other, and
where surrogates collide, or equal an entity that occurs, the later entity
takes the next surrogate of its sequence.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.runtime import materialize

#: Given names of the gazetteer by script and gender; a surrogate is another one of the same list.
#: The lengths are primes, so that a keyed step runs through a whole list.
GIVEN_NAMES = {
    ("latin", "female"): "Anna Maria Laura Sophie Emma Julia Clara Elena Carmen Lucia Camille Amelie Ingrid Helga Mary Susan Linda",
    ("latin", "male"): "John James Robert Michael Thomas Peter Paul Carlos Miguel Pablo Pierre Antoine Klaus Jürgen Hans David Daniel",
    ("cyrillic", "female"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья",
    ("cyrillic", "male"): "Иван Пётр Алексей Сергей Дмитрий Андрей Николай Михаил Павел Олег Юрий",
    ("greek", "female"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα",
    ("greek", "male"): "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Ανδρέας Στέφανος",
}
#: Titles after which one or two capitalised words are a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme"
#: Syllables of surrogate family names.
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ka ke ki la le li lo ma me mi mo na ne no ra re ri ro sa se ta to",
    "cyrillic": "ба бе бо да де до га го ка ке ки ла ле ли ло ма ме ми мо на не но ра ре ри ро са се си та те то",
    "greek": "βα βε βο δα δε δο γα γο κα κε κι λα λε λι λο μα με μι μο να νε νο ρα ρε ρι ρο σα σε σι τα τε το",
}

_GIVEN = [name for names in GIVEN_NAMES.values() for name in names.split()]
_WORD = r"\p{Lu}\p{L}{1,30}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
KEY = r"(?<![\p{L}\p{N}])AKIA[A-Z0-9]{16}(?![\p{L}\p{N}])"
SECRET = (r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}"
          r"[\"']?(?=[A-Za-z_/+-]{0,127}\d)[A-Za-z0-9_/+-]{8,128}")
PHONE = r"(?<![\p{L}\p{N}+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{N}-])"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"
CARD = r"(?<![\p{L}\p{N}-])(?:\d{13,19}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}(?: \d{4}){2} \d{1,7})(?![\p{L}\p{N}-])"
NAME = (rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{'|'.join(TITLES.split())})\.? {_WORD}(?: {_WORD})?|(?:{'|'.join(_GIVEN)}) {_WORD})(?!\p{{L}})")
#: No entity begins inside a word or number; asked first, this spares most places the seven alternatives.
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in (EMAIL, KEY, SECRET, PHONE, IP, CARD, NAME)) + ")"
#: Surrogate addresses are of a block that is not routed.
IP_FIRST = 240


def _let(value: Column, body) -> Column:
    """`body` of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(match: Column) -> Column:
    """Type of a match; NULL for groups of digits that are no valid card number, which are left alone."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (F.when(match.rlike(f"^{EMAIL}$"), "email").when(match.rlike(f"^{KEY}$"), "key").when(match.rlike(f"^{SECRET}$"), "secret")
            .when(match.rlike(f"^{PHONE}$"), "phone").when(match.rlike(f"^{IP}$"), "ip")
            .when(match.rlike("^[0-9 -]+$"), F.when(_checksum(digits) % 10 == 0, "card").when(match.rlike("^[0-9]+$"), "number"))
            .otherwise("name"))


def _checksum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled and cast out by nine."""
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda total, d: total + d)


def _secret_value(match: Column) -> Column:
    return F.regexp_extract(match, r"([A-Za-z0-9_/+-]+)$", 1)


def _normal(kind: Column, match: Column) -> Column:
    """The form that all ways to write an entity share."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (F.when(kind == "email", F.lower(match)).when(kind == "phone", F.substring(digits, F.length(digits) - 9, F.lit(10)))
            .when(kind.isin("card", "number"), digits).when(kind == "secret", _secret_value(match)).otherwise(match))


def _stream(key: str, kind: Column, normal: Column, attempt: Column, blocks: int = 2) -> Column:
    """Hexadecimal digits of keyed hashes, 64 for each block."""
    seed = F.concat_ws("|", F.lit(hashlib.sha256(key.encode()).hexdigest()), kind, normal, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{b}")), 256) for b in range(blocks)])


def _number(stream: Column, at: Column | int, width: int = 6) -> Column:
    """A number from `width` digits of the stream, beginning at the 0-based place, taken in a ring."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(F.concat(stream, F.substring(stream, F.lit(1), F.lit(width))), start % F.length(stream) + 1, F.lit(width)),
                  16, 10).cast("bigint")


def _pick(word: str, at: Column) -> Column:
    return F.substring(F.lit(word), (at % len(word) + 1).cast("int"), F.lit(1))


def _reshape(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Each digit, small and capital letter gives way to another of its class; other characters stay."""

    def one(i):
        c, n = F.substring(text, i, F.lit(1)), _number(stream, 3 * i, 6)
        return (F.when(c.rlike("[0-9a-f]") & hexadecimal, _pick("0123456789abcdef", n)).when(c.rlike("[0-9]"), _pick("0123456789", n))
                .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
                .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _into(format_: Column, digits: Column, kept: Column) -> Column:
    """The characters of `format_` with the given digits in the places of its digits, after the first `kept` of them."""

    def one(i):
        c = F.substring(format_, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(format_, F.lit(1), i), "[^0-9]", "")) - kept
        return F.when(c.rlike("[0-9]") & (rank > 0), F.substring(digits, rank, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(format_)), one), "")


def _digits(stream: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: (_number(stream, 3 * i) % 10).cast("string")), "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _family(word: Column, key: str, attempt: Column) -> Column:
    """A made-up family name in the script of the word; later attempts are longer."""
    lists = {script: F.array(*[F.lit(p) for p in parts.split()]) for script, parts in SYLLABLES.items()}
    script = _script(word)
    names = F.when(script == "cyrillic", lists["cyrillic"]).when(script == "greek", lists["greek"]).otherwise(lists["latin"])

    def of(stream):
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + attempt), lambda i: F.element_at(
            names, (_number(stream, 5 * i) % F.size(names) + 1).cast("int"))), ""))

    return _let(_stream(key, F.lit("word"), F.lower(word), attempt), of)


def _given(word: Column, key: str) -> Column:
    """Another given name of the same list, by a keyed step that sends different names to different ones; else NULL."""
    pairs = []
    for names in GIVEN_NAMES.values():
        listed = names.split()
        step = 1 + int(hashlib.sha256(f"{key}|{listed[0]}".encode()).hexdigest(), 16) % (len(listed) - 1)
        for k, name in enumerate(listed):
            pairs += [F.lit(name), F.lit(listed[(k + step) % len(listed)])]
    return F.element_at(F.create_map(*pairs), word)


def _name(match: Column, key: str, attempt_of) -> Column:
    """Titles stay, listed given names change places, other words become family names of their script."""
    titles = [t + dot for t in TITLES.split() for dot in ("", ".")]
    return F.array_join(F.transform(F.split(match, " "), lambda w: F.when(w.isin(titles), w).otherwise(
        F.coalesce(_given(w, key), _family(w, key, attempt_of(F.lit("word"), F.lower(w)))))), " ")


def _canonical(kind: Column, normal: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity's normal form, which is what must differ between entities."""

    def of(stream):
        # Local part by shape, longer from attempt to attempt; the domain is one of the reserved ones.
        local = F.concat(_reshape(F.substring_index(normal, "@", 1), stream, F.lit(False)),
                         F.when(attempt > 0, _digits(stream, attempt + 3)).otherwise(""))
        top = F.element_at(F.array(*[F.lit(t) for t in ("com", "net", "org")]), (_number(stream, 101) % 3 + 1).cast("int"))
        email = F.concat(local, F.lit("@mail"), (_number(stream, 113) % 10000).cast("string"), F.lit(".example."), top)
        ten = F.concat((2 + _number(stream, 7) % 8).cast("string"), _digits(stream, F.lit(2)),
                       (2 + _number(stream, 90) % 8).cast("string"), F.substring(_digits(stream, F.lit(8)), F.lit(3), F.lit(6)))
        ip = F.concat_ws(".", (IP_FIRST + _number(stream, 1) % (255 - IP_FIRST)).cast("string"),
                         *[(_number(stream, 9 * k) % 256).cast("string") for k in (1, 2, 3)])
        # All but the first digit, which tells the brand, and the check digit, which follows from the rest.
        body = F.concat(F.substring(normal, F.lit(1), F.lit(1)), _digits(stream, F.length(normal) - 2))
        card = _let(body, lambda d: F.concat(d, F.pmod(F.lit(10) - _checksum(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        shaped = _reshape(F.when(kind == "key", F.substring(normal, F.lit(5), F.lit(16))).otherwise(normal), stream,
                          (kind == "secret") & normal.rlike("^[0-9a-f]+$"))
        return (F.when(kind == "email", email).when(kind == "phone", ten).when(kind == "ip", ip).when(kind == "card", card)
                .when(kind == "key", F.concat(F.lit("AKIA"), shaped)).when(kind.isin("secret", "number"), shaped))

    return F.when(kind == "word", _family(normal, key, attempt)).otherwise(_let(_stream(key, kind, normal, attempt), of))


def _surrogate(match: Column, key: str, attempt_of) -> Column:
    """The surrogate of a match as it stands in the text."""

    def of(kind, normal, canonical):
        digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
        label = F.length(match) - F.length(normal)  # of a secret
        capitals = match.rlike(r"\p{Lu}") & ~match.rlike(r"\p{Ll}")
        return (F.when(kind == "email", F.when(capitals, F.upper(canonical)).otherwise(canonical))
                .when(kind == "phone", _into(match, canonical, digits - 10)).when(kind == "card", _into(match, canonical, F.lit(0)))
                .when(kind == "secret", F.concat(F.substring(match, F.lit(1), label), canonical)).otherwise(canonical))

    def by(kind):
        whole = _let(_normal(kind, match), lambda normal: _let(_canonical(kind, normal, key, attempt_of(kind, normal)),
                                                               lambda canonical: of(kind, normal, canonical)))
        return F.when(kind.isNull(), match).when(kind == "name", _name(match, key, attempt_of)).otherwise(whole)

    return _let(_kind(match), by)


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, normal) of all different entities; the words of a name are entities of their own."""
    found = (docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))).alias("match")).distinct()
             .withColumn("kind", _kind(F.col("match"))).filter("kind is not null"))
    found = materialize(found)
    plain = found.filter("kind <> 'name'").select("kind", _normal(F.col("kind"), F.col("match")).alias("normal"))
    titles = [t + dot for t in TITLES.split() for dot in ("", ".")]
    words = found.filter("kind = 'name'").select(F.explode(F.split("match", " ")).alias("word")).filter(~F.col("word").isin([*titles, *_GIVEN]))
    return plain.unionByName(words.select(F.lit("word").alias("kind"), F.lower("word").alias("normal"))).distinct()


def settle(entities: DataFrame, key: str, canonical=_canonical) -> DataFrame:
    """(kind, normal, attempt) of the entities that must not take the first surrogate of their sequence.

    Of entities with one surrogate the one that took it with fewest attempts
    keeps it (of equals the first in order); a surrogate that is itself an
    entity of the corpus is given up too. Repeats until all differ.
    """
    now = materialize(entities.withColumn("attempt", F.lit(0)))
    while True:
        drawn = now.withColumn("surrogate", F.lower(canonical(F.col("kind"), F.col("normal"), key, F.col("attempt"))))
        taken = now.select("kind", F.lower("normal").alias("surrogate"), F.lit(1).alias("real")).distinct()
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "normal")  # a few colliding entities each
        judged = (drawn.join(taken, ["kind", "surrogate"], "left").withColumn("place", F.row_number().over(order))
                  .withColumn("again", (F.col("place") > 1) | F.col("real").isNotNull()))
        judged = materialize(judged.select("kind", "normal", "attempt", "again"))
        if judged.filter("again").isEmpty():
            return now.filter("attempt > 0")
        now = judged.select("kind", "normal", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", entities_col: str | None = None) -> DataFrame:
    """The rows with all their columns, entities of the text replaced; `entities_col` adds the number replaced.

    Rows without entities pass unchanged, NULL stays NULL, repeated rows are
    changed alike, and NULL ids do no harm. Runs jobs while it is built: one scan
    gathers the different entities and settles collisions.
    """
    again = settle(_entities(docs, text_col), key)
    text, mark = F.col(text_col), "__again"
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    rows = docs.withColumn("__found", F.coalesce(matches, F.array().cast("array<string>")))
    if again.isEmpty():
        rows = rows.withColumn(mark, F.lit(None).cast("map<string,int>"))
    else:
        # Rows that hold an entity with a later attempt get its number; a row is known by its id and text.
        row = F.xxhash64(id_col, text_col)
        each = (docs.select(row.alias("__row"), F.explode(F.array_distinct(matches)).alias("match")).distinct()
                .withColumn("kind", _kind(F.col("match"))))
        parts = F.when(F.col("kind") == "name", F.transform(F.split("match", " "), lambda w: F.struct(F.lit("word").alias("kind"), F.lower(w).alias("normal"))))
        whole = F.array(F.struct(F.col("kind"), _normal(F.col("kind"), F.col("match")).alias("normal")))
        each = each.select("__row", F.explode(F.coalesce(parts, whole)).alias("e")).select("__row", "e.*").distinct().join(again, ["kind", "normal"])
        numbers = each.groupBy("__row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias(mark))
        rows = rows.withColumn("__row", row).join(numbers, "__row", "left").drop("__row")

    def attempt_of(kind, normal):
        return F.coalesce(F.element_at(F.col(mark), F.concat_ws("|", kind, normal)), F.lit(0))

    pieces = F.split(text, PATTERN, -1)
    new = F.transform("__found", lambda m: _surrogate(m, key, attempt_of))
    joined = F.concat_ws("", F.element_at(pieces, 1), F.concat_ws("", F.zip_with(new, F.slice(pieces, F.lit(2), F.size("__found")), lambda a, b: F.concat(a, b))))
    changed = F.when(F.size("__found") > 0, joined).otherwise(text)
    out = rows.withColumn(text_col, changed)
    if entities_col:
        out = out.withColumn(entities_col, F.size(F.filter("__found", lambda m: _kind(m).isNotNull())).cast("long"))
    return out.select(*docs.columns, *[entities_col] * bool(entities_col))
