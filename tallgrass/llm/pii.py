"""Personal data: base patterns, and further spans that boosted trees pick among high-recall candidates.

Base spans (email, ip, card, phone) are fixed patterns with checks; they always stay. Five generators propose further
spans, which may overlap each other and the base: written-out addresses, dotted numbers, digit runs with any
separators, long runs of letters and digits (secrets), and coded account numbers. Gradient-boosted trees score
candidates by format and context.

The trees learn from planted spans whose labels do not come from the base patterns: on a bounded sample (TRAIN_DOCS
documents by hash of doc_id), base spans are rewritten within their own contexts into forms that the base misses
(addresses with `at` and `dot`, other separators, no plus sign, a mistyped digit), and secrets, account numbers and
look-alikes (orders, dates, versions, prices, decimals, digests, paths) drawn from hashes are put into the documents'
contexts. Half of the sample's documents fit the trees, the other half calibrates: per kind, the least score whose
candidates above it reach PRECISION is the threshold; a kind without one adds nothing. So precision and recall (in the
fit's report) are those on planted spans of the kinds and shares below. A candidate at or above its threshold that
overlaps no base span and no earlier chosen candidate is added; kinds beyond the base are `secret` and `id`.

All of it is DataFrame functions: positions come from the lengths of the pieces between matches, trees become CASE
expressions inside `transform`. The main pass is narrow: no shuffle, no Python. Patterns are possessive where
backtracking cannot succeed, and look behind so that a long run is scanned once; they match what the plain ones match.

Defined cases: a null text counts as empty; texts of any length are searched whole; repeated rows each get a row;
without documents to plant in no span is added; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import saved

TRAIN_DOCS, TREES, DEPTH, PRECISION = 20_000, 16, 4, 0.99
#: Of the planted forms below, a document of the sample gets one in so many.
ONE_IN = 5
BLOCK = 512
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "id")
LOCAL = "[A-Za-z0-9._%+-]"
#: At the start of a run, or right behind the last match.
FROM_LOCAL, FROM_DIGIT = rf"(?:(?<!{LOCAL})|\G)", r"(?:(?<![0-9])|\G)"
BASE = {
    "email": rf"{FROM_LOCAL}{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"{FROM_DIGIT}[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HOST, AT, DOT = "[A-Za-z0-9-]", r" ?[\[({](?i:at)[\])}] ?", r" ?[\[({](?i:dot)[\])}] ?"
SAID_AT = rf" (?i:at) (?={HOST}++ (?i:dot) )"
RUN = "[A-Za-z0-9+/_-]"
CANDIDATES = {
    "mail": rf"(?<!{LOCAL}){LOCAL}++(?: ?@ ?|{AT}|{SAID_AT}){HOST}++(?:(?:\.|{DOT}| (?i:dot) ){HOST}++)++",
    "dotted": r"(?<![0-9.])[0-9]++(?:(?:\.|\[\.\]|\(\.\))[0-9]++){3}+(?![0-9])",
    "digits": r"(?<![0-9+])\+?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
    "secret": rf"(?<!{RUN})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){RUN}{{16,}}+={{0,2}}+",
    "coded": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: What a text must have to be searched by a generator.
NEEDS = {
    "mail": rf"@|[\[({{](?i:at)[\])}}]| (?i:at) {HOST}++ (?i:dot) ",
    "dotted": r"[0-9][\[(]?+\.[\])]?+[0-9]",
    "digits": r"[0-9](?:[\x20()./-]{0,2}+[0-9]){6}",
    "secret": rf"{RUN}{{16}}",
    "coded": r"[A-Z]{2}[0-9]{2}",
}
#: Words near a span that tell its kind.
CONTEXT = {
    "says_phone": "(?i)(?:phone|tel|call|fax|mobile|whatsapp)",
    "says_card": "(?i)(?:card|visa|credit|debit|pay)",
    "says_mail": "(?i)(?:mail|contact|write|send)",
    "says_host": "(?i)(?:ip|host|server|address|login)",
    "says_secret": "(?i)(?:token|secret|passw|pwd|api|key|auth|bearer|credential)",
    "says_id": "(?i)(?:iban|ssn|social|passport|account|tax)",
    "says_other": "(?i)(?:order|invoice|item|version|isbn|date|commit|page|build|sha|md5|serial|uuid|price|total|tracking|class|file|#)",
}
#: Known beginnings of access keys, and endings of host names.
KEY_START, HOST_END = "^(?:AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ)", "(?i)(?:com|org|net|edu|gov|info|io|[a-z]{2})$"
FEATURES = (
    "length", "digits", "letters", "groups", "plus", "at", "dots", "dashes", "slashes", "spaces", "longest_group", "first_group", "last_group", "distinct",
    "hex", "uuid", "date", "luhn", "ssn", "zeros", "key_start", "host_end", "assigned", "after_word", "before_word", *CONTEXT,
)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as structs (start, end, value, left, right) with code point offsets and contexts.

    Offsets add up in blocks, so that the work stays in proportion even to very many matches in one text.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), F.slice(pieces, F.lit(2), F.size(hits)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        hits,
        lambda p, h: F.struct(F.length(p.a).alias("gap"), F.length(h).alias("n"), h.alias("value"), F.right(p.a, F.lit(24)).alias("left"), F.left(p.b, F.lit(8)).alias("right")),
    )
    span = "struct<start:int,end:int,value:string,left:string,right:string>"

    def in_block(rows: Column) -> Column:
        return F.aggregate(
            rows,
            F.struct(F.array().cast(f"array<{span}>").alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.array_append(acc.out, F.struct((acc.at + x.gap).alias("start"), (acc.at + x.gap + x.n).alias("end"), x.value.alias("value"), x.left.alias("left"), x.right.alias("right"))).alias("out"),
                (acc.at + x.gap + x.n).alias("at"),
            ),
        )

    # blocks of BLOCK matches: offsets within each, then the blocks' own offsets
    blocks = F.transform(chunks(rows), in_block)
    placed = F.aggregate(
        blocks,
        F.struct(F.array().cast(f"array<array<{span}>>").alias("out"), F.lit(0).alias("at")),
        lambda acc, b: F.struct(
            F.array_append(
                acc.out,
                F.transform(b.out, lambda x: F.struct((x.start + acc.at).alias("start"), (x.end + acc.at).alias("end"), x.value.alias("value"), x.left.alias("left"), x.right.alias("right"))),
            ).alias("out"),
            (acc.at + b["at"]).alias("at"),
        ),
    )
    return F.flatten(placed.out)


def chunks(rows: Column) -> Column:
    """An array cut into arrays of BLOCK."""
    count = F.ceil(F.size(rows) / BLOCK).cast("int")
    one = F.array(rows)
    many = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(rows) <= BLOCK, one).otherwise(many)


def luhn(value: Column) -> Column:
    d = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(d)

    def part(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i))
    return n.between(16, 19) & F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_matches(text: Column) -> dict[str, Column]:
    """Matches of every base kind that pass their check; texts without the character that a kind needs are passed over."""
    digits = lambda x: F.length(F.regexp_replace(x.value, "[^0-9]", ""))
    found = {
        "email": matches(text, BASE["email"]),
        "ip": F.filter(matches(text, BASE["ip"]), lambda x: small_parts(x.value)),
        "card": F.filter(matches(text, BASE["card"]), lambda x: luhn(x.value)),
        "phone": F.filter(matches(text, BASE["phone"]), lambda x: digits(x).between(8, 15)),
    }
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?+[0-9]){15}"), "phone": F.contains(text, F.lit("+"))}
    return {k: F.when(needs[k], c) for k, c in found.items()}


def base_spans(text: Column) -> dict[str, Column]:
    slim = lambda c: F.transform(c, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return {k: F.coalesce(slim(c), none) for k, c in base_matches(text).items()}


def featured(x: Column, generator: str) -> Column:
    """A candidate with its kind and features."""
    digits = F.regexp_replace(x.value, "[^0-9]", "")
    groups = F.filter(F.split(x.value, "[^0-9]+"), lambda g: g != "")
    ssn = x.value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    many = F.when(ssn, "id").when(F.length(digits) >= 13, "card").otherwise("phone")
    kind = {"mail": F.lit("email"), "dotted": F.lit("ip"), "digits": many, "secret": F.lit("secret"), "coded": F.lit("id")}[generator]
    as_number = lambda b: b.cast("double")
    count = lambda c: F.length(x.value) - F.length(F.replace(x.value, F.lit(c), F.lit("")))
    values = {
        "length": F.length(x.value),
        "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(x.value, "[^A-Za-z]", "")),
        "groups": F.size(groups),
        "plus": as_number(F.startswith(x.value, F.lit("+"))),
        "at": as_number(F.contains(x.value, F.lit("@"))),
        "dots": count("."),
        "dashes": count("-"),
        "slashes": count("/"),
        "spaces": count(" "),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split(F.left(x.value, F.lit(64)), ""))),
        "hex": as_number(x.value.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        "uuid": as_number(x.value.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "date": as_number(x.value.rlike("(?:19|20)[0-9]{2}[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12][0-9]|3[01])")),
        "luhn": as_number(luhn(x.value)),
        "ssn": as_number(ssn),
        "zeros": as_number(F.startswith(x.value, F.lit("00"))),
        "key_start": as_number(x.value.rlike(KEY_START)),
        "host_end": as_number(x.value.rlike(HOST_END)),
        "assigned": as_number(x.left.rlike(r"[:=] ?[\"']?$")),
        "after_word": as_number(x.left.rlike(r"[\p{L}\p{N}_]$")),
        "before_word": as_number(x.right.rlike(r"^[\p{L}\p{N}_]")),
    } | {k: as_number(x.left.rlike(p)) for k, p in CONTEXT.items()}
    return F.struct(x.start.alias("start"), x.end.alias("end"), kind.alias("kind"), *(values[k].cast("double").alias(k) for k in FEATURES))


def featured_by(generator: str):
    return lambda x: featured(x, generator)


def candidates(text: Column) -> Column:
    kind = "array<struct<start:int,end:int,kind:string," + ",".join(f"{k}:double" for k in FEATURES) + ">>"
    return F.concat(*(F.when(text.rlike(NEEDS[g]), F.transform(matches(text, p), featured_by(g))).otherwise(F.array().cast(kind)) for g, p in CANDIDATES.items()))


# -- planted spans -----------------------------------------------------------------------------------------------------


def rewritten(kind: str, value: Column) -> list[Column]:
    """Forms of a base span that the base patterns do not find."""
    d = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        said = lambda at, dot: F.concat(local, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
        return [said(a, b) for a, b in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), (" (AT) ", "."))]
    if kind == "ip":
        return [F.replace(value, F.lit("."), F.lit(x)) for x in ("[.]", "(.)")]
    if kind == "card":
        return [grouped(d, x) for x in (".", "/")] + [grouped(mistyped(d), x) for x in ("", " ", "-")]
    return [*(grouped(d, x, 3) for x in (".", "/", "-", " ")), F.concat(F.lit("00"), grouped(d, " ", 3))]


def grouped(d: Column, by: str, size: int = 4) -> Column:
    return F.regexp_replace(d, f"([0-9]{{{size}}})(?=[0-9])", f"$1{by}") if by else d


def mistyped(d: Column) -> Column:
    """Another last digit."""
    return F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))


def invented() -> list[tuple[str, int, Column, Column]]:
    """(kind, label, words before, value) drawn from hashes of doc_id: 1 for spans to be found, 0 for look-alikes."""
    salt = iter(range(10_000))
    number = lambda n: F.lpad(F.pmod(F.xxhash64("doc_id", F.lit(next(salt))), F.lit(10**n)).cast("string"), n, "0")
    upto = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(next(salt))), F.lit(n))
    hexed = lambda n: F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{next(salt)}")), 512), 1, n)
    mixed = lambda n: F.substring(F.regexp_replace(F.base64(F.unhex(hexed(128))), "[+/=]", "x"), 1, n)
    one = lambda *words: F.get(F.array(*map(F.lit, words)), upto(len(words)).cast("int"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    join = lambda *parts: F.concat(*map(lit, parts))
    day = lambda by: join(F.lit("20"), number(2), by, F.lpad((1 + upto(12)).cast("string"), 2, "0"), by, F.lpad((1 + upto(28)).cast("string"), 2, "0"))
    words = lambda: one("token", "secret", "password", "api_key", "apiKey", "access_key", "auth", "PASSWORD", "TOKEN", "client_secret")
    plain = F.lit("")
    yes = [
        ("secret", join(words(), ' = "'), hexed(40)), ("secret", join(words(), ": "), mixed(32)), ("secret", join(words(), "="), hexed(32)), ("secret", join(words(), " = '"), mixed(24)),
        ("secret", plain, join("AKIA", F.upper(hexed(16)))), ("secret", plain, join("ghp_", mixed(36))), ("secret", plain, join("sk_live_", mixed(24))), ("secret", F.lit("Bearer "), mixed(40)),
        ("secret", join(words(), ' = "'), F.upper(hexed(40))),
        ("card", plain, number(16)), ("card", plain, grouped(number(16), " ")), ("card", plain, grouped(number(16), "-")), ("card", one("card ", "visa ", ""), join("3", one("4", "7"), number(2), " ", number(6), " ", number(5))),
        ("phone", one("tel ", "call ", "phone: ", ""), join("(0", number(2), ") ", number(3), "-", number(4))), ("phone", one("tel ", "call ", "", ""), join(number(3), "-", number(3), "-", number(4))),
        ("phone", one("tel ", "call ", "fax: "), number(10)), ("phone", one("tel ", "mobile ", ""), join("0", number(3), "/", number(7))), ("phone", plain, join(number(3), ".", number(3), ".", number(4))),
        ("id", one("IBAN ", "iban: ", "account ", ""), grouped_code(join(one("DE", "FR", "ES", "GB", "IT", "NL"), number(2), number(18)))), ("id", one("IBAN ", "iban: ", "account "), join(one("DE", "FR", "ES", "GB"), number(2), number(18))),
        ("id", one("SSN ", "social security ", ""), join(number(3), "-", number(2), "-", number(4))),
        ("email", one("mail ", "write to ", ""), join(one("anna", "j.smith", "info"), upto(100).cast("string"), one(" at ", " [at] ", "(at)"), one("mail", "post", "work"), one(" dot ", "[dot]"), one("com", "org", "de"))),
        ("ip", one("host ", "from ", ""), join(upto(256).cast("string"), "[.]", upto(256).cast("string"), "[.]", upto(256).cast("string"), "[.]", upto(256).cast("string"))),
    ]
    no = [
        ("phone", one("order #", "order ", "invoice ", "item "), number(9)), ("phone", one("item ", "sold ", ""), number(8)), ("phone", plain, join(day("-"), " ", number(2))), ("phone", plain, join(day("."), ", ")), ("card", plain, join(day(""), number(6))),
        ("phone", one("pages ", "pp. ", ""), join(number(4), "-", number(4))), ("phone", one("price ", "total ", ""), join("1.", number(3), ".", number(3))), ("phone", plain, join("1 ", number(3), " ", number(3))), ("card", plain, join("3.", number(15))),
        ("phone", plain, join("0.", number(9))), ("card", one("ISBN ", ""), join("978-3-", number(2), "-", number(6), "-", number(1))), ("card", one("tracking ", "order "), number(13)), ("card", plain, number(18)), ("card", plain, join(number(18), number(18))),
        ("card", plain, F.repeat(one("0", "1", "9"), F.lit(16))), ("phone", plain, F.repeat(one("0", "1", "9"), F.lit(10))),
        ("ip", one("version ", "v", "build "), join(upto(20).cast("string"), ".", upto(30).cast("string"), ".", (300 + upto(5000)).cast("string"), ".", upto(90).cast("string"))), ("ip", one("section ", ""), join(upto(9).cast("string"), ".", upto(9).cast("string"), ".", (300 + upto(700)).cast("string"), ".", (256 + upto(9)).cast("string"))),
        ("secret", one("commit ", "sha ", "rev "), hexed(40)), ("secret", one("sha256 ", "sha256:"), hexed(64)), ("secret", one("md5 ", ""), hexed(32)),
        ("secret", one("uuid ", "id ", 'id = "', ""), F.regexp_replace(hexed(32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")), ("secret", plain, join("/static/js/app-", hexed(8), "/main")), ("secret", one('class = "', "class: "), join("section-header-", number(2), "-wide")),
        ("secret", one('build = "', "build: "), join(day("-"), "-nightly-linux64")), ("secret", one("file ", ""), join("IMG_", day(""), "_", number(6), "_HDR")), ("secret", one('color = "', 'size: "'), join("primary-shade-", number(3), "-x")), ("secret", plain, join("chapter-", number(1), "-the-long-", one("road", "night", "way"))),
        ("id", one("serial ", "model ", "part "), join(F.upper(one("ab", "xk", "zz")), number(2), " ", F.upper(hexed(4)), " ", F.upper(hexed(4)), " ", F.upper(hexed(4)))), ("email", one("look at ", ""), join(one("smile", "look", "stare"), " at ", one("polka", "red", "the"), " dot ", one("dress", "product", "matrix"))),
    ]
    return [(k, 1, left, v) for k, left, v in yes] + [(k, 0, left, v) for k, left, v in no]


def grouped_code(code: Column) -> Column:
    return F.regexp_replace(code, "(.{4})(?=.)", "$1 ")


def planted(drawn: DataFrame) -> DataFrame:
    """(doc_id, kind, label, text, start, end): short texts with a planted span, made from the documents drawn."""
    row = lambda kind, label, left, value, right: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), left.alias("left"), value.alias("value"), right.alias("right"))
    text = F.coalesce("text", F.lit(""))
    base = drawn.select("doc_id", *(c.alias(k) for k, c in base_matches(text).items()))
    form = lambda k, i: lambda x: row(k, 1, x.left, rewritten(k, x.value)[i], x.right)
    forms = [F.transform(k, form(k, i)) for k in KINDS for i in range(len(rewritten(k, F.lit(""))))]
    none = F.array().cast("array<struct<kind:string,label:int,left:string,value:string,right:string>>")
    rewrote = base.select("doc_id", F.explode(F.concat(*(F.coalesce(f, none) for f in forms))).alias("x"))
    window = lambda i: F.substring(text, F.pmod(F.xxhash64("doc_id", F.lit(-i)), F.greatest(F.length(text) - 30, F.lit(1))).cast("int") + 1, F.lit(30))
    every = [row(k, y, F.concat(F.left(window(i), F.lit(20)), F.lit(" "), left), v, F.concat(F.lit(" "), F.right(window(i), F.lit(8)))) for i, (k, y, left, v) in enumerate(invented(), 1)]
    some = F.array(*(F.when(F.pmod(F.xxhash64("doc_id", F.lit(i + 20_000)), F.lit(ONE_IN)) == 0, x) for i, x in enumerate(every)))
    made = drawn.select("doc_id", F.explode(F.array_compact(some)).alias("x"))
    both = rewrote.unionByName(made).select("doc_id", "x.*")
    return both.select("doc_id", "kind", "label", F.concat("left", "value", "right").alias("text"), F.length("left").alias("start"), (F.length("left") + F.length("value")).alias("end"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind (columns email, ip, card, phone) and the candidates of every document."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return text.select("doc_id", *(c.alias(k) for k, c in base_spans(F.col("t")).items()), candidates(F.col("t")).alias("found"))


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (x.start < s.end) & (s.start < x.end))


def tree_score(model, x: Column) -> Column:
    """The model's probability as an expression over a candidate's features."""

    def grown(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        at = FEATURES[node.split().featureIndex()]
        return F.when(x[at] <= float(node.split().threshold()), grown(node.leftChild())).otherwise(grown(node.rightChild()))

    total = sum((grown(t._java_obj.rootNode()) * w for t, w in zip(model.trees, model.treeWeights, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * total))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[object, dict[str, float], dict[str, tuple[float, float]]] | None:
    """Boosted trees, the calibrated threshold of each kind, and its (precision, recall) on the planted spans that
    calibrate; None without documents."""
    total = docs.count()
    share = min(1.0, train_docs / max(total, 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = planted(drawn).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0).withColumn("found", candidates(F.col("text")))
    mine = F.filter("found", lambda x: (x.kind == F.col("kind")) & (x.start < F.col("end")) & (F.col("start") < x.end))
    # the candidate that covers most of the planted span stands for it; a span that no generator proposes is a miss
    cover = F.array_max(F.transform(mine, lambda x: F.struct((F.least(x.end, F.col("end")) - F.greatest(x.start, F.col("start"))).alias("n"), x.alias("x"))))
    rows = saved(rows.select("half", F.col("kind").alias("planted"), F.col("label").cast("double").alias("label"), cover.x.alias("x")).select("half", "planted", "label", "x.*"), "pii")
    found = rows.where("kind IS NOT NULL")
    learn = found.where("half").groupBy(*FEATURES, "label").count()
    if learn.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learn)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="count", seed=1).fit(ready)
    rest = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.where("NOT half"))
    scored = model.transform(rest).withColumn("p", F.floor(F.get(vector_to_array("probability"), F.lit(1)) * 1000) / 1000)
    by = scored.groupBy("kind", "p").agg(F.sum("label").alias("yes"), F.count("*").alias("n"))  # 1000 scores a kind
    above = Window.partitionBy("kind").orderBy(F.col("p").desc())
    best = by.withColumns({"found": F.sum("yes").over(above), "precision": F.sum("yes").over(above) / F.sum("n").over(above)}).where(F.col("precision") >= PRECISION)
    best = best.groupBy("kind").agg(F.min(F.struct("p", "precision", "found")).alias("x"))
    there = {r.planted: r.n for r in rows.where("NOT half AND label = 1").groupBy("planted").agg(F.count("*").alias("n")).collect()}
    best = {r.kind: r.x for r in best.collect()}
    return model, {k: x.p for k, x in best.items()}, {k: (x.precision, x.found / there[k]) for k, x in best.items() if k in there}


def redactions(docs: DataFrame, fitted: tuple | None) -> DataFrame:
    """doc_id, base spans by kind, and `added`: structs (kind, start, end) that the model adds, by start."""
    found = spans(docs)
    slim = "array<struct<kind:string,start:int,end:int>>"
    if not fitted or not fitted[1]:
        return found.drop("found").withColumn("added", F.array().cast(slim))
    model, least = fitted[:2]
    known = F.concat(*(F.col(k) for k in KINDS))
    limit = lambda x: F.coalesce(*(F.when(x.kind == k, F.lit(v)) for k, v in least.items()))
    found = found.withColumn("known", known)
    chosen = F.filter("found", lambda x: ~overlaps(x, F.col("known")) & (tree_score(model, x) >= limit(x)))
    ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("end"), x.kind.alias("kind"))))
    apart = F.aggregate(
        ordered,
        F.struct(F.array().cast(slim).alias("out"), F.lit(0).alias("to")),
        lambda a, x: F.when(x.start >= a.to, F.struct(F.array_append(a.out, F.struct(x.kind.alias("kind"), x.start.alias("start"), (-x.end).alias("end"))).alias("out"), (-x.end).alias("to"))).otherwise(a),
    ).out
    return found.select("doc_id", *KINDS, apart.alias("added"))


def digested(found: DataFrame) -> DataFrame:
    """Counts and span lists of redactions()."""
    said = lambda kind, c: F.transform(c, lambda x: F.concat_ws(":", F.lit(kind), x.start.cast("string"), x.end.cast("string")))
    base = F.concat(*(said(k, F.col(k)) for k in KINDS))

    def every(kind: str) -> Column:
        more = F.transform(F.filter("added", lambda x: x.kind == kind), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
        return said(kind, F.array_sort(F.concat(F.col(kind), more) if kind in KINDS else more))

    added = lambda kind: F.size(F.filter("added", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*map(every, ALL_KINDS)), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        *(added(k).alias(f"n_added_{k}") for k in ALL_KINDS),
        (sum((F.size(k) for k in KINDS), F.lit(0)) + F.size("added")).cast("long").alias("n_spans"),
    )
