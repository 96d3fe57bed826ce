"""Personal data: exact patterns, and more identifiers found by the contexts that the exact ones stand in.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracite.session import cut, pick, small

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only contexts find: values of secrets, and whatever else stands where identifiers stand.
MORE_KINDS = ("secret", "other")
#: Labels whose assigned values are secrets wherever they stand. They are no seeds: contexts must find them again.
LABELS = ("access[_-]?key", "api[_-]?key", "auth[_-]?key", "passwd", "password", "private[_-]?key", "secret", "token")
#: Characters that, like spaces, are no part of a context word.
_MARKS = "\"'=:()[]<>,;!?"
#: Stands for a dot or separator inside an identifier while patterns are applied; texts that hold it have it replaced first.
INNER, OTHER = "\ue000", "\ue001"
_NOSPACE = r"[^\x20\x09-\x0D]"
_SPACES = "\t\n\x0b\f\r"
_SPANS = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def _word_before(gap: Column) -> Column:
    """Last word of a gap in lower case, empty if there is none."""
    return F.lower(F.substring_index(F.rtrim(F.translate(gap, _SPACES + _MARKS, " " * 20)), " ", -1))


def _word_after(gap: Column) -> Column:
    return F.lower(F.substring_index(F.ltrim(F.translate(gap, _SPACES + _MARKS, " " * 20)), " ", 1))


def context_words(text: Column) -> Column:
    """All words of a text as contexts see them."""
    return F.split(F.lower(F.translate(text, _SPACES + _MARKS, " " * 20)), " +")


def spans(text: Column, pattern: str, kind: int, holds: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches of a pattern that ``holds``, with places in code points and the words around.

    Splitting by the pattern gives the gaps between the very matches that extraction gives, so running lengths of gaps
    and matches are the places. The pair is bound once, however often it is used.
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"),
            _word_before(F.concat(state["last"], x["gap"])).alias("left"), _word_after(F.concat(x["next"], F.coalesce(x["later"], F.lit("")))).alias("right"),
        )
        more = F.when(F.coalesce(holds(x["value"]), F.lit(False)), F.concat(state["out"], F.array(one))).otherwise(state["out"])
        return F.struct(F.coalesce(end, start).alias("at"), F.coalesce(x["value"], F.lit("")).alias("last"), more.alias("out"))

    def placed(x: Column) -> Column:
        after = lambda name: F.slice(x[name], F.lit(2), F.size(x["gaps"]))
        rows = F.arrays_zip(x["gaps"].alias("gap"), x["values"].alias("value"), after("gaps").alias("next"), after("values").alias("later"))
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.expr(f"cast(array() as {_SPANS})").alias("out")), step, lambda s: s["out"])

    return F.transform(F.array(found), placed)[0]


def _digits(value: Column) -> Column:
    return F.translate(value, f" ().+-{INNER}", "")


def _luhn(digits: Column) -> Column:
    def term(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def _part_small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and then by start.

    The patterns are those of the contract, put so that Java's matcher neither recurses nor tries a long run again from
    each of its characters: a dot (or a card's separator) between two label characters (digits) is first replaced by
    INNER, which makes a domain or a card number one run of one character class.
    """
    clean = F.translate(text, INNER, OTHER)
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER)
    local = rf"[A-Za-z0-9._%+{INNER}-]"
    email = spans(dotted, rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++{INNER}[A-Za-z0-9{INNER}-]++", 0, lambda v: v.isNotNull())
    ip = spans(clean, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 1, lambda v: F.forall(F.split(v, r"\."), _part_small))
    run = rf"[0-9{INNER}]"
    card = spans(
        F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", INNER), f"(?<!{run})[0-9]{run}{{12,36}}+(?!{run})", 2,
        lambda v: F.length(_digits(v)).between(13, 19) & _luhn(_digits(v)),
    )
    phone = spans(clean, r"\+[0-9][\x20().0-9-]+[0-9]", 3, lambda v: F.length(_digits(v)).between(9, 15))
    none = F.expr(f"cast(array() as {_SPANS})")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        F.when(text.rlike("[0-9]"), card).otherwise(none),
        F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
    )


def candidate_spans(text: Column) -> Column:
    """Words with a digit or @, with following words of digits, that look like a kind; the exact patterns may miss them."""
    pattern = rf"(?<!{_NOSPACE})[^\x20\x09-\x0D0-9@]*+[0-9@]{_NOSPACE}*+(?:\x20[0-9().-]++(?!{_NOSPACE})){{0,6}}+"
    bare = lambda v: F.rtrim(v, F.lit(".,;:!?"))
    numeric = lambda v: bare(v).rlike(r"^[+(]?[0-9][0-9() .-]*[0-9]$")
    looks = lambda v: (
        F.when(bare(v).rlike("^[^@]++@[^@]++$"), 0)
        .when(bare(v).rlike(r"^[0-9a-fA-F]{1,4}(?:[.:][0-9a-fA-F]{0,4}){3,7}$"), 1)
        .when(numeric(v) & F.length(_digits(v)).between(16, 19), 2)
        .when(numeric(v) & F.length(_digits(bare(v))).between(7, 15), 3)
    )
    raw = spans(text, pattern, -1, lambda v: looks(v).isNotNull())
    return F.transform(
        raw,
        lambda s: F.struct(
            looks(s["value"]).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(bare(s["value"]))).alias("end"),
            bare(s["value"]).alias("value"), s["left"].alias("left"), s["right"].alias("right"),
        ),
    )


def labelled_secrets(text: Column) -> Column:
    """Values, of 8 characters or more, that are assigned to one of LABELS, and blocks of private keys; each whole, however long.

    A value has a digit, an underscore, a sign, a capital inside or letters on both sides of a hyphen, so that a word of prose behind a colon is none.
    """
    label = "|".join(LABELS)
    held = r"[A-Za-z0-9_.+/!@#$%^&*~=-]"
    value = rf"(?<=(?i:(?:{label})[\"']?[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?))(?<!{held}){held}{{8,}}+|(?<=[=])(?<=(?i:(?:{label})[\"']?[ ]{{0,2}}=)){held}{{8,}}+"
    values = spans(text, value, len(KINDS), lambda v: v.rlike(r"[0-9_!@#$%^&*~=]|[a-z][A-Z]|[A-Za-z]-[A-Za-z]"))
    block = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,8}+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
    none = F.expr(f"cast(array() as {_SPANS})")
    assigned = text.rlike("[=:]") & text.rlike(rf"(?i)(?:{label})[\"']?[ ]{{0,2}}[=:]")
    return F.concat(
        F.when(assigned, values).otherwise(none),
        F.when(F.contains(text, F.lit("-----BEGIN")), spans(text, block, len(KINDS), lambda v: v.isNotNull())).otherwise(none),
    )


def shaped_seeds(text: Column) -> Column:
    """Words that look random by themselves: 20 characters or more, 15 of them distinct, six digits and six letters at least."""
    one = "[A-Za-z0-9_+-]"
    count = lambda v, of: F.length(F.regexp_replace(v, of, ""))
    random = lambda v: (count(v, "[^0-9]") >= 6) & (count(v, "[^A-Za-z]") >= 6) & (F.size(F.array_distinct(F.split(v, ""))) >= 15)
    found = spans(text, rf"(?<![A-Za-z0-9_+/-]){one}{{20,}}+(?![A-Za-z0-9_+/-])", len(KINDS), random)
    return F.when(text.rlike("[0-9]") & text.rlike(f"(?<!{one}){one}{{20}}"), found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def further_spans(text: Column) -> Column:
    """Words of any kind that may be identifiers: with a digit, @ or _, or beginning with a capital letter."""
    pattern = r"(?<![^\x20\x09-\x0D\"'=:(\[<,;])(?=\p{Lu}|[^\x20\x09-\x0D\"'=:()\[\]<>,;!?]*[0-9@_])[\p{L}0-9_@][^\x20\x09-\x0D\"'=:()\[\]<>,;!?]{2,}+"
    bare = lambda v: F.rtrim(v, F.lit(".!?*#$%&"))
    secret = lambda v: (F.length(bare(v)) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    raw = spans(text, pattern, -1, lambda v: v.isNotNull())
    return F.transform(
        raw,
        lambda s: F.struct(
            F.when(secret(s["value"]), len(KINDS)).otherwise(len(KINDS) + 1).alias("kind"), s["start"].alias("start"),
            (s["start"] + F.length(bare(s["value"]))).alias("end"), bare(s["value"]).alias("value"), s["left"].alias("left"), s["right"].alias("right"),
        ),
    )


def _apart(spans_of: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans_of, lambda c: ~F.exists(others, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def _beside(uses: DataFrame) -> DataFrame:
    """side, word, value, n, seed: how often each distinct value stands beside each word."""
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("word")), F.struct(F.lit("right").alias("side"), F.col("right").alias("word")))
    rows = uses.select(F.lower("value").alias("value"), "seed", F.explode(sides).alias("at")).select("value", "seed", "at.side", "at.word")
    return rows.where("word <> ''").groupBy("side", "word", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))


def _key(text: Column) -> Column:
    """Equal texts have equal spans, so whatever is found is kept for each text once, without the text."""
    return F.unhex(F.md5(text))


def _words_in(texts: DataFrame, words: DataFrame, most: int = 10_000) -> DataFrame:
    """key, met: the uses of the words in the texts (key, text), of which equal ones count once; texts without one are left out.

    Up to ``most`` words are looked up in the scan itself, so only their uses leave it; up to 16 are first looked for as they are.
    """
    used = context_words(F.col("text"))
    named = [r["word"] for r in words.limit(most + 1).collect()]
    if len(named) <= most:
        low, may = F.lower("text"), F.lit(len(named) > 16)
        for w in named if len(named) <= 16 else ():
            may = may | F.contains(low, F.lit(w))
        met = texts.where(may).select("key", F.filter(used, lambda w: w.isin(named)).alias("met")).where("size(met) > 0")
    else:
        each = texts.select("key", F.monotonically_increasing_id().alias("row"), F.explode(used).alias("word")).join(small(words), "word", "left_semi")
        met = each.groupBy("key", "row").agg(F.collect_list("word").alias("met"))
    return met.groupBy("key").agg(F.first("met").alias("met"))


def _counted(met: DataFrame, name: str) -> DataFrame:
    return met.select(F.explode("met").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias(name))


def discovered(texts: DataFrame, known: DataFrame, rounds: int = 3, accept: float = 0.8, least: int = 3, share: float = 0.2) -> DataFrame:
    """Identifiers that the contexts of known ones vouch for.

    texts: key, text (equal ones count once); known: key, seeds (array of spans) of the texts that have any. A pattern is a
    word on one side of an identifier; ``least`` distinct seeds must induce it, and in the whole corpus at least ``share`` of the word's uses
    must stand beside seeds. All other words that stand in a pattern and may be identifiers are its instances. In each
    round a pattern's score is the score of its instances, by use, over that and its uses beside plain words and, for a quarter, its
    uncertain instances, damped where its known instances are few; an instance's score is the chance that one of its patterns is right.
    Seeds score 1 throughout. Instances are distinct values, so a text that was copied a thousand times vouches for no
    more values, and no pattern's rows are ever gathered. Seeds of the kind secret, which only their shape speaks for, must be vouched for
    like all others.

    Returns key and spans of the instances that their patterns alone score ``accept`` or more. Texts are read, and never written.
    """
    seeds = known.select("key", F.explode("seeds").alias("s")).select("key", "s.*", F.lit(True).alias("seed"))
    beside = cut(_beside(seeds))
    induced = cut(beside.groupBy("side", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= least))
    # A word that is too frequent even in the texts with seeds alone need not be counted in all.
    often = _counted(_words_in(texts.join(small(known.select("key")), "key", "left_semi"), induced.select("word").distinct()), "here")
    rare = cut(induced.join(often, "word").where(F.col("n") >= share * F.col("here")).drop("here"))
    met = cut(_words_in(texts, rare.select("word").distinct()))
    patterns = cut(rare.join(_counted(met, "total"), "word").where(F.col("n") >= share * F.col("total")).select("side", "word", "total"))
    asked = small(cut(patterns.select("word").distinct()))
    holding = small(cut(met.select("key", F.explode("met").alias("word")).join(asked, "word", "left_semi").select("key").distinct()))
    held = texts.join(holding, "key", "left_semi").dropDuplicates(["key"]).join(small(known), "key", "left").withColumn("seeds", F.coalesce("seeds", F.expr(f"cast(array() as {_SPANS})")))
    held = held.withColumn("shaped", _apart(candidate_spans(F.col("text")), F.col("seeds")))
    open_ = F.concat("shaped", _apart(_apart(further_spans(F.col("text")), F.col("seeds")), F.col("shaped")))
    uses = held.select("key", F.explode(open_).alias("s")).select("key", "s.*", F.lit(False).alias("seed"))
    met = [uses.join(small(patterns.where(F.col("side") == side).select(F.col("word").alias(side))), side, "left_semi") for side in ("left", "right")]
    uses = cut(met[0].unionByName(met[1]).distinct())
    edges = cut(_beside(seeds.unionByName(uses)).join(small(patterns), ["side", "word"]))
    scores = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        sums = edges.join(scores, "value").groupBy("side", "word", "total").agg(F.sum("score").alias("values"), F.sum(F.col("score") * F.col("n")).alias("used"), F.sum("n").alias("uses"))
        doubt = F.greatest(F.col("total") - F.col("uses"), F.lit(0)) + (F.col("uses") - F.col("used")) / 4
        scored = sums.select("side", "word", (F.col("used") / (F.col("used") + doubt) * F.col("values") / (F.col("values") + 1)).alias("pattern"))
        vouched = (1 - F.exp(F.sum(F.log(1 - F.col("pattern"))))).alias("vouched")
        scores = cut(
            edges.join(scored, ["side", "word"]).groupBy("value").agg(F.max("seed").alias("seed"), vouched)
            .select("value", "vouched", F.when(F.col("seed"), 1.0).otherwise(F.col("vouched")).alias("score"))
        )
    good = scores.where(F.col("vouched") >= accept).select(F.col("value").alias("lowered"))
    every = uses.unionByName(seeds.where(F.col("kind") >= len(KINDS)))
    return every.withColumn("lowered", F.lower("value")).join(small(good), "lowered", "left_semi").select("key", "kind", "start", "end", "value", "left", "right").distinct()


def find_private(docs: DataFrame, carry: tuple[str, ...] = (), accept: float = 0.8) -> DataFrame:
    """Personal data in every whole text: base spans by the exact patterns, secrets by their labels, and what context discovers.

    Seeds are the base spans and words that look random (``shaped_seeds``); what ``discovered`` adds takes the kind that it
    looks like, or other. Discovery is over the whole table, so adding documents can add spans to others. Spans have no greatest length.

    Null text counts as empty: no spans. Repeated rows and null doc_ids are rows of their own. Empty table: no rows.
    Other columns than ``carry`` are ignored. Texts are not written to checkpoints: what is found is kept by a hash of the text.

    Returns doc_id, the carried columns, base, spans (base ones and discovered ones of the four kinds) and others
    (secrets, and other identifiers; a secret may overlap a base span): arrays of (kind number, start, end, value, left, right), by kind and
    start; end is exclusive and places are code points.
    """
    docs = pick(docs, "doc_id", "text", *[c for c in carry if c != "text"])
    none = F.expr(f"cast(array() as {_SPANS})")
    rich = F.coalesce(F.col("text").rlike("[0-9@+=:]|-----BEGIN"), F.lit(False))
    texts = docs.where(F.col("text").isNotNull()).select(_key(F.col("text")).alias("key"), "text")
    spans_of = docs.where(rich).select("text").withColumn("base", base_spans(F.col("text"))).withColumn("secrets", labelled_secrets(F.col("text"))).withColumn("shapes", _apart(shaped_seeds(F.col("text")), F.col("base")))
    any_ = spans_of.where("size(base) + size(secrets) + size(shapes) > 0").select(_key(F.col("text")).alias("key"), "base", "secrets", "shapes")
    found = cut(any_.groupBy("key").agg(*[F.first(c).alias(c) for c in ("base", "secrets", "shapes")]))
    new = discovered(texts, found.select("key", F.concat("base", "shapes").alias("seeds")).where("size(seeds) > 0"), accept=accept)
    new = new.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "value", "left", "right")).alias("new"))
    both = found.drop("shapes").join(new, "key", "full").select("key", *[F.coalesce(c, none).alias(c) for c in ("base", "secrets", "new")])
    every = F.array_sort(F.concat("base", "secrets", _apart(F.col("new"), F.col("secrets"))))
    by_text = cut(both.select("key", "base", every.alias("every")))
    # Texts without a span meet nothing: their own keys, of eight bytes, keep them apart.
    own = F.when(F.col("text").isNotNull(), _key(F.col("text"))).otherwise(F.unhex(F.hex(F.xxhash64("doc_id"))))
    joined = docs.withColumn("key", own).join(small(by_text), "key", "left")
    of = lambda test: F.filter(F.coalesce("every", none), lambda s: test(s["kind"]))
    return joined.select("doc_id", *carry, F.coalesce("base", none).alias("base"), of(lambda k: k < len(KINDS)).alias("spans"), of(lambda k: k >= len(KINDS)).alias("others"))


def _listed(spans_of: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS + MORE_KINDS])
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, all spans of the four kinds as text, and all others as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), _listed("others").alias("others"))


def redacted(docs: DataFrame, columns: tuple[str, ...] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets, and n_chars to fit.

    Where spans of two kinds overlap, the first one's mark stands for both. All documents stay; null text stays null.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS + MORE_KINDS])
    found = find_private(docs, columns).withColumn("spans", F.concat("spans", "others"))

    def step(state: Column, s: Column) -> Column:
        free = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(free, piece).otherwise(state["out"]).alias("out"))

    by_place = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    masked = F.aggregate(
        by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select("doc_id", *columns)
