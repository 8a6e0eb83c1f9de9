"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame operations only.

A candidate is a value after an assignment or a word such as password, what begins with a known prefix of keys, or any long run of characters that keys are
made of, with a digit in it. Its features are its length, changes of character class, variety,
coverage by dictionary words, path signs and the words around it. The forest is trained on labelled findings that SQL makes
from a range of numbers; its trees become one expression, so texts are scored where they are read and nothing is shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of keys, and the length of the shortest run that is a candidate wherever it stands.
MIN_CHARS = 16
_KEY = "A-Za-z0-9+/_=\\-"
#: What keys of known services begin with.
PREFIX = "AKIA|ASIA|gh[pousr]_|sk-|sk_live_|xox[bp]-|AIza|eyJ|glpat-"
#: A value of any length and signs, up to a blank, quotation mark, bracket or the next assignment; a full stop after it isn't part of it.
_ENDS = "\\s\"'`<>(){}\\[\\],;=:"
_VALUE = f"(?!//)[^{_ENDS}]*[^{_ENDS}.?]={{0,2}}"
_ASSIGNED = "(?<=[=:]\\s{0,3}[\"'`]?)(?<![=:][=:])"
_SAID = "(?<=[\\s\"'`])(?<=(?i:token|secret|password|passwd|pwd|key|auth|bearer|credential|credentials)[\"'`]?\\s{1,2}(?:is\\s)?[\"'`]?)"
#: Each run is looked at once, from its start; an equals sign is part of it only at its end.
_BARE = "A-Za-z0-9+/_\\-"
_PADDED = f"(?:={{1,2}}+(?![{_BARE}]))?"
_RUN = f"(?<![{_KEY}])(?=[A-Za-z+/_\\-]*+[0-9])[{_BARE}]{{{MIN_CHARS},}}+{_PADDED}"
CANDIDATE = f"(?<=[=:\\s\"'`])(?:{_ASSIGNED}|{_SAID}){_VALUE}|(?<![{_KEY}])(?:{PREFIX})[{_BARE}]++{_PADDED}|{_RUN}"
#: Code points of context on both sides.
CONTEXT = 40
#: Labelled findings that the forest is trained on, its trees, their depth and the least rows of a leaf.
TRAINING, TREES, DEPTH, LEAF = 2400, 15, 6, 8
#: The share of trees' votes from which a candidate is a secret.
THRESHOLD = 0.5
MASK = "[SECRET]"

#: Words of names, paths and prose.
DICTIONARY = "access account action admin album android apple application archive article assets author backup banner basic bin block blog book build button cache camera category center change channel check class client cloud code color column comment common config console contact content control copy core count create credit custom data date default delete design detail develop device doc document domain download edit email engine error event example export feature file filter final first font form forum frame free function gallery game general get global group guide handler hash header health help home html http icon image import include index info input install item java key label language layout level lib license light link list local log login mail main manager map media member menu message method mobile model module music name network news node note number object office online open option order origin output package page panel park part path photo plugin point policy post power press price print private product profile program project property public python query random read record release remote report request resource response result role root route sample save school screen script search section secure select server service session setting share shop site size source special staff star start state static status stop storage store stream string style submit summary support system table target team template test text theme thread time title tool total track train travel type update upload url user utils value version video view web width window work world write".split()

#: Words before a key, and before what only looks like one.
FOR = "token|secret|passw(?:or)?d|pwd|api[_ -]?key|apikey|access[_ -]?key|auth|bearer|credential|private[_ -]?key|key"
AGAINST = "commit|sha-?1|sha-?256|md5|hash|checksum|digest|revision|uuid|guid|etag|card|order|invoice|isbn|serial|phone|fingerprint|file|path|image|src|href|url"

FEATURES = ("chars", "changes", "distinct", "digits", "upper", "lower", "hexadecimal", "dictionary", "slashes", "separators", "looks_path", "uuid_form", "prefix", "said_for", "said_against", "assigned", "quoted", "symbols")


def features(before: Column, found: Column, after: Column) -> Column:
    """The candidate's features as a struct of doubles."""
    n = F.length(found).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[+/_=-]+", "-")
    low = F.lower(found)

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(found, pattern, ""))) / n

    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    tail = F.lower(F.right(before, F.lit(CONTEXT)))
    near = F.right(tail, F.lit(24))

    def has(text: Column, pattern: str) -> Column:
        return text.rlike(pattern).cast("double")

    made = {
        "chars": n,
        "changes": (F.length(classes) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hexadecimal": has(low, "^[0-9a-f]+$"),
        "dictionary": (n - F.length(F.regexp_replace(low, words, ""))) / n,
        "slashes": n - F.length(F.replace(found, F.lit("/"), F.lit(""))),
        "separators": share("[_-]"),
        "looks_path": F.greatest(has(F.right(before, F.lit(2)), r"[./~\\]$"), has(after, r"^\.(?:[a-z]{2,4})\b")),
        "uuid_form": has(low, "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        "prefix": has(found, f"^(?:{PREFIX})"),
        "said_for": has(near, FOR),
        "said_against": has(near, f"(?:^|[^a-z])(?:{AGAINST})(?:[^a-z]|$)"),
        "assigned": has(near, "[=:]\\s*[\"']?$"),
        "symbols": share(f"[^{_KEY}.]"),
        "quoted": has(F.concat(F.right(before, F.lit(1)), F.left(after, F.lit(1))), "^[\"'`]{2}$"),
    }
    return F.struct(*(F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


def labelled_findings(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """before, found, after, secret: findings made from a range of numbers, half of them secrets."""
    def cased(i: int) -> Column:
        return F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")).cast("binary"), 256)))

    hexed = F.sha1(F.col("id").cast("string").cast("binary"))
    hexed64 = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    turn = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(6)).cast("int")
    digits = F.regexp_replace(hexed64, "[a-f]", "")
    plain = F.regexp_replace(cased(1), "[+/=]", "")

    def word(i: int) -> Column:
        return F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(DICTIONARY))) + 1).cast("int"))

    def pick(*texts: str) -> Column:
        return F.element_at(F.array(*map(F.lit, texts)), F.pmod(turn, F.lit(len(texts))) + 1)

    secrets = [
        (pick('token = "', 'api_key = "', "secret: ", 'auth_token="', "password = '", "key="), hexed),
        (pick('token = "', 'api_key = "', "secret: ", 'access_key="', "password = '", "Bearer "), F.substring(plain, 1, 32)),
        (pick("aws ", 'key = "', "id: ", "", "use ", 'access_key="'), F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16)))),
        (pick("token ", 'GITHUB_TOKEN="', "", "with ", "auth ", "git "), F.concat(F.lit("ghp_"), F.substring(plain, 1, 36))),
        (pick('password = "', "passwd: ", "pwd=", "secret ", 'password="', "key: "), F.concat(F.substring(plain, 1, 9), F.lit("_"), F.substring(digits, 1, 8))),
        (pick('secret = "', "private_key: ", 'token = "', "auth: ", "credential ", "api key "), hexed64),
        (pick("use ", "", "with ", "and ", 'x = "', "new "), F.concat(F.lit("sk-"), F.substring(plain, 1, 40))),
        (pick('token = "', "secret=", 'apikey: "', "bearer ", 'auth = "', "password "), cased(2)),
    ]
    letters = F.upper(F.regexp_replace(F.concat(cased(3), cased(4)), "[^A-Za-z]", ""))
    given = ('password = "', "passwd: ", "pwd=", "secret: ", 'password="', "password is ")
    secrets += [
        (pick("aws ", 'key = "', "id: ", "", "use ", 'access_key="'), F.concat(F.lit("AKIA"), F.substring(letters, 1, 16))),
        (pick(*given), F.concat_ws("-", word(3), word(4), word(5), word(6))),
        (pick(*given), F.concat(word(3), F.substring(digits, 1, 1), word(4))),
        (pick(*given), F.concat(word(3), F.substring(digits, 1, 3))),
        (pick(*given), F.concat(F.substring(plain, 1, 5), F.element_at(F.array(*map(F.lit, "!&@#$%")), turn + 1), F.substring(plain, 6, 4), F.lit("!"))),
        (pick(*given), F.concat(word(3), word(4), word(5))),
    ]
    others = [
        (pick("password ", "the key ", "a token ", "secret ", "auth ", "bearer "), word(3)),
        (pick("password: ", "token=", 'secret = "', "key: ", "auth: ", "pwd="), F.element_at(F.array(*map(F.lit, "none null true false required string text optional yes no unknown empty".split())), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(12)) + 1).cast("int"))),
        (pick("note: ", "size = ", "color: ", 'type="', "x = ", "name: "), word(3)),
        (pick("note: ", "width = ", "port: ", 'id="', "at 10:", "total: "), F.substring(digits, 1, 3)),
        (pick("note: ", "kind = ", "content: ", 'type="', "title: ", "name: "), F.concat_ws("-", word(3), word(4))),
        (pick("use ", "file: ", "load = ", 'src="', "path: ", "open "), F.concat_ws(".", word(3), F.concat(word(4), F.lit("()")))),
        (pick("the ", "use ", "", "with ", "a ", "our "), F.concat(F.lit("sk-"), word(3))),
        (pick("commit ", "sha1 ", "revision ", "checksum: ", "hash ", "md5 "), hexed),
        (pick("id ", "uuid: ", "guid ", "", "the ", "request "), F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))),
        (pick("in /", "./", "see /", "href=/", "file /", "path: /"), F.concat_ws("/", word(3), word(4), F.concat(word(5), F.lit("2")), word(6))),
        (pick("the ", "call ", "", "with ", "of ", "our "), F.concat(word(3), F.initcap(word(4)), F.initcap(word(5)), F.substring(digits, 1, 2))),
        (pick("card ", "", "to ", "order ", "and ", "number "), F.substring(digits, 1, 16)),
        (pick("from ", "", "at ", "on ", "log ", "until "), F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("T0"), F.substring(digits, 5, 1), F.lit("-00-00"))),
        (pick("the ", "in ", "", "table ", "column ", "of "), F.concat_ws("_", word(3), word(4), word(5), F.substring(digits, 1, 3))),
        (pick("digest ", "etag: ", "fingerprint ", "sha256 ", "checksum ", "hash: "), hexed64),
    ]
    kind = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(secrets + others)))
    before, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (b, x) in enumerate(secrets + others):
        before, found = F.when(kind == k, b).otherwise(before), F.when(kind == k, x).otherwise(found)
    after = F.when(before.endswith('"'), '" and').when(before.endswith("'"), "'").otherwise(" and")
    return spark.range(0, n, 1, 1).select(F.concat(F.lit("of the "), before).alias("before"), found.alias("found"), after.alias("after"), (kind < len(secrets)).alias("secret"))


Tree = tuple  # (share of secrets,) or (feature, edge, tree up to the edge, tree above it)


def _grow(rows: list[tuple[list[float], bool]], depth: int, r: random.Random) -> Tree:
    """A tree of the rows: at each node the split of least impurity among a few features drawn."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * LEAF:
        return (share,)
    best = None
    for f in r.sample(range(len(FEATURES)), 6):
        values = sorted((x[f], y) for x, y in rows)
        total, n, left = sum(y for _, y in values), len(values), 0
        for k in range(1, n):
            left += values[k - 1][1]
            if values[k][0] == values[k - 1][0] or k < LEAF or n - k < LEAF:
                continue
            impurity = left * (1 - left / k) + (total - left) * (1 - (total - left) / (n - k))
            if best is None or impurity < best[0]:
                best = (impurity, f, (values[k - 1][0] + values[k][0]) / 2)
    if best is None:
        return (share,)
    _, f, edge = best
    low, high = [x for x in rows if x[0][f] <= edge], [x for x in rows if x[0][f] > edge]
    return (f, edge, _grow(low, depth - 1, r), _grow(high, depth - 1, r))


def train(rows: list[tuple[list[float], bool]], trees: int = TREES, seed: int = 5) -> list[Tree]:
    """A random forest: each tree on rows drawn with replacement."""
    r = random.Random(seed)
    return [_grow(r.choices(rows, k=len(rows)), DEPTH, r) for _ in range(trees)]


@lru_cache(maxsize=4)
def _forest(application: str) -> tuple[Tree, ...]:
    spark = SparkSession.active()
    made = labelled_findings(spark)
    rows = made.select(features(F.col("before"), F.col("found"), F.col("after")).alias("x"), "secret").collect()
    return tuple(train([([r["x"][f] for f in FEATURES], r["secret"]) for r in rows]))


def forest(spark: SparkSession) -> list[Tree]:
    """The forest of labelled_findings(), trained once an application; the same in each."""
    return list(_forest(spark.sparkContext.applicationId))


def vote(trees: list[Tree], x: Column) -> Column:
    """The mean of the trees' shares for a struct of features."""
    def walk(t: Tree) -> Column:
        if len(t) == 1:
            return F.lit(float(t[0]))
        f, edge, low, high = t
        return F.when(x[FEATURES[f]] <= F.lit(float(edge)), walk(low)).otherwise(walk(high))

    total = walk(trees[0])
    for t in trees[1:]:
        total = total + walk(t)
    return total / len(trees)


#: Candidates whose places are summed along together; the sums of such runs are summed in turn.
RUN = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it: a projection of its own could be merged into body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it; runs of RUN are summed along, then the runs' totals, so that no long array is copied for each value."""
    def along(some: Column) -> Column:
        seed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(some, seed, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(RUN)), lambda i: F.slice(values, i, F.lit(RUN)))

    def with_totals(rs: Column) -> Column:
        totals = F.transform(rs, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))
        return _let(along(totals), lambda base: F.flatten(F.transform(rs, lambda x, k: F.transform(along(x), lambda y: y + F.get(base, k)))))

    return _let(runs, with_totals)


def _scored(docs: DataFrame) -> DataFrame:
    """docs with _found: pieces, the texts between candidates, and rows, the candidate, start and score of each; null where there is no candidate."""
    trees = forest(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))

    def rows(pieces: Column, names: Column) -> Column:
        widths = F.zip_with(pieces, names, lambda p, c: (F.length(p) + F.coalesce(F.length(c), F.lit(0))).cast("long"))
        scored = F.transform(names, lambda c, k: features(F.get(pieces, k), c, F.get(pieces, k + 1)))
        return _let(_sums_before(widths), lambda before: F.zip_with(names, F.transform(scored, lambda x, k: F.struct((F.get(before, k) + F.length(F.get(pieces, k))).alias("start"), vote(trees, x).alias("score"))), lambda c, s: F.struct(c.alias("found"), s["start"].alias("start"), s["score"].alias("score"))))

    found = _let(F.split(text, CANDIDATE, -1), lambda pieces: _let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda names: F.struct(pieces.alias("pieces"), rows(pieces, names).alias("rows"))))
    return docs.withColumn("_found", F.when(text.rlike(CANDIDATE), found))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, sha256, score, secret of every candidate in every document (doc_id, text); start and end in code points, end exclusive.

    The candidate itself isn't returned, only its hash. A null or empty text has none; repeated rows give repeated rows; null doc_ids
    are kept; other columns are ignored. A very long text with very many candidates is the work of one row, in proportion to its length.
    """
    rows = _scored(docs.select("doc_id", "text")).filter("_found IS NOT NULL").select("doc_id", F.explode("_found.rows").alias("f"))
    n = F.length("f.found")
    return rows.select("doc_id", F.col("f.start").cast("long").alias("start"), (F.col("f.start") + n).cast("long").alias("end"), F.sha2(F.col("f.found").cast("binary"), 256).alias("sha256"), F.col("f.score").alias("score"), (F.col("f.score") >= THRESHOLD).alias("secret"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with MASK for each secret in text, and n_chars of what is left; others, and other columns, as they are."""
    columns = docs.columns
    kept = F.zip_with("_found.pieces", "_found.rows", lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.when(f["score"] >= THRESHOLD, F.lit(MASK)).otherwise(F.coalesce(f["found"], F.lit("")))))
    rows = _scored(docs).withColumn("_text", F.when(F.col("_found").isNotNull(), F.array_join(kept, "")))
    out = {"text": F.coalesce("_text", "text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.withColumns(out).select(*columns)
