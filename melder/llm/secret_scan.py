"""Secret scans (operator 2), in DataFrame functions and Spark's own random forest alone.

A text is cut into tokens and the gaps between them, in one pass of one pattern. Tokens are long
runs of key-like characters (dots inside them included) and values of any kind that a secret's
name and `=` or `:` announce. A token yields candidates: itself, and its parts between `=` and
between dots that are long enough. Each candidate is described by its length, its character
classes and the transitions between them, how much of it dictionary fragments cover, the words
on both sides of it and the path of its document; a random forest trained on labelled findings
tells secrets from words, hashes, paths and placeholders. The trained trees become one SQL
expression that is evaluated over a row's candidates, so that no row is exploded, shuffled or
sent to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHORTEST = 16  # of a run; values that a name announces may be shorter
SHORTEST_VALUE = 6
TREES, DEPTH, SEED = 20, 7, 7
LEARN_ROWS = 12_000  # labelled findings that are generated if none are given
CUT = 0.5
MASK = "[secret]"

BODY = "[A-Za-z0-9_+/=-]"
AROUND = 48  # code points beside a candidate that can hold a neighbour: a word of 31, marks and blanks
#: The word and the marks; a name directly before `=` may hold digits or be one letter.
BEFORE = r"([A-Za-z][A-Za-z_-]{1,30}|(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]{0,30}(?==))([\s\x22\x27:=]{1,6})$"
AFTER = r"^[\s\x22\x27,;:.()]{1,6}([A-Za-z]{2,30})(?![A-Za-z0-9_+/=-])"
#: Parts of a run between its `=`; those at its end are padding and belong to the last part.
PART = "[^=]+(?:=+$)?"

#: Word fragments of the dictionary, words that announce secrets or identifiers,
#: beginnings of well-known keys, and words of placeholders and of paths that hold no real keys.
FRAGMENTS = "tion|ing|ment|ness|able|ible|ence|ance|ous|ive|the|and|for|with|that|this|from|have|not|are|was|you|all|can|her|one|our|out|day|get|has|him|his|how|man|new|now|old|see|two|way|who|did|its|let|put|say|she|too|use|int|str|data|file|name|type|user|test|code|time|list|view|http|www|com|org|html|index|config|version|license|public|general|keit|schaft|lich|ung|der|die|das|und|sch|que|ión|ado|mente|eux|aux|oire|elle"
SECRET_WORDS = "token|secret|passw|passwd|password|pwd|key|apikey|auth|bearer|credential|private|access|signature"
PLAIN_WORDS = "commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|id|ref|rev|revision|version|build|etag|isbn|order|invoice|phone|path|url|file|class|function|import"
KNOWN_KEYS = "^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ|npm_|pypi-)"
PLACEHOLDERS = "example|sample|your|xxxx|dummy|changeme|placeholder|insert|redacted|todo|0000|1234567|abcdef"
TEST_PATHS = "test|example|sample|fixture|mock|docs?/"
#: Parts of the names whose values are looked at whatever they hold.
NAMES = "token|secret|passw|pwd|api_?key|auth|credential|private_?key|access_?key"

#: A run, tried at its start only.
RUN = f"(?<!{BODY})(?=[.{BODY[1:]}{{{SHORTEST}}}){BODY}+(?:[.]{BODY}+)*"
#: A name, the marks behind it, and its value up to a blank, quote or bracket.
VALUE = rf"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{{0,24}}?(?i:{NAMES})[A-Za-z0-9_-]{{0,12}})([\x22\x27]?\s{{0,2}}[:=]{{1,2}}\s{{0,2}}[\x22\x27]?)([^\s\x00-\x20\x22\x27<>,;&()\[\]{{}}]{{{SHORTEST_VALUE},}})"
TOKEN = f"{VALUE}|{RUN}"

FEATURES = ("length", "digits", "upper", "transitions", "distinct", "hex", "dictionary", "vowels", "same_run", "secret_word", "plain_word", "assigned", "slashes", "test_path", "known_key", "placeholder", "symbols", "dots", "secret_after", "plain_after")


def features(c: str, before: str, marks: str, after: str, path: str) -> str:
    """SQL for the array of FEATURES of a candidate, from SQL for it, its surroundings and its path."""

    def removed(text: str, pattern: str) -> str:
        return f"(length({text}) - length(regexp_replace({text}, r'{pattern}', '')))"

    n = f"length({c})"
    flag = lambda text, pattern: f"if({text} rlike r'{pattern}', 1D, 0D)"
    return "array(" + ", ".join(
        [
            f"cast({n} as double)",
            f"{removed(c, '[0-9]')} / {n}",
            f"{removed(c, '[A-Z]')} / {n}",
            f"(size(regexp_extract_all({c}, r'[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+', 0)) - 1) / {n}",
            f"size(array_distinct(split({c}, ''))) / least({n}, 40)",
            flag(c, "^[0-9a-fA-F]+$"),
            f"{removed(f'lower({c})', FRAGMENTS)} / {n}",
            f"{removed(c, '[aeiouAEIOU]')} / greatest({removed(c, '[A-Za-z]')}, 1)",
            flag(c, r"(.)\1{3}"),
            flag(f"lower({before})", f"({SECRET_WORDS})$"),
            flag(f"lower({before})", f"^({PLAIN_WORDS})$"),
            flag(marks, "[=:]"),
            f"{removed(c, '[/+]')} / {n}",
            flag(f"lower({path})", TEST_PATHS),
            flag(c, KNOWN_KEYS),
            flag(f"lower({c})", PLACEHOLDERS),
            f"{removed(c, '[^A-Za-z0-9_+/=.-]')} / {n}",
            f"{removed(c, '[.]')} / {n}",
            flag(f"lower({after})", f"^({SECRET_WORDS})$"),
            flag(f"lower({after})", f"^({PLAIN_WORDS})$"),
        ]
    ) + ")"


def findings(spark: SparkSession, rows: int = LEARN_ROWS) -> DataFrame:
    """Labelled findings (candidate, before, marks, after, path, label), made by rule from a hash of
    the row number: keys of several alphabets and lengths, passwords, and words, paths, host names,
    placeholders, numbers and checksums that look like them. A project's own labelled findings may
    take their place.
    """
    spin = lambda k, m: f"cast(pmod(xxhash64(id, '{k}'), {m}) as int)"

    def text(alphabet: str, length: str, k: str) -> str:
        return f"array_join(transform(sequence(1, {length}), i -> substr('{alphabet}', 1 + cast(pmod(xxhash64(id, '{k}', i), {len(alphabet)}) as int), 1)), '')"

    hexes, wide = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "array('the','and','er','ing','tion','sch','keit','ung','que','mente','ión','oire','elle','ness','able','ver','ent','licen','gene','ral')"

    def word(k: str, least: int, more: int) -> str:
        return f"array_join(transform(sequence(1, {least} + {spin(k, more)}), i -> get({syllables}, cast(pmod(xxhash64(id, '{k}', i), 20) as int))), '')"

    def cased(w: str) -> str:
        return f"case {spin('wc', 4)} when 0 then initcap({w}) when 1 then upper({w}) else {w} end"

    long_word, short_word = cased(word("w", 4, 5)), word("s", 2, 2)
    secret_word = f"get(array('token','secret','password','api_key','apikey','auth_token','private_key','Bearer','access_key'), {spin('sw', 9)})"
    plain_word = f"get(array('commit','sha256','md5','checksum','uuid','id','version','path','url','file'), {spin('pw', 10)})"
    any_word = f"get(array('the','on','and','de','erti','sch','von','thly','','',''), {spin('aw', 11)})"
    mark = f"get(array(' = \"','=',': ',':\"'), {spin('m', 4)})"
    some_after = f"get(array('','','the','is','and','file','de','sch'), {spin('fa', 8)})"
    path = f"get(array('src0','src1','crawl/main','app/config.py','tests/fixtures/keys','docs/example.md','lib/auth.go','web'), {spin('p', 8)})"
    password = f"concat(substr({short_word}, 1, 6), {text('0123456789', f'1 + {spin("pd", 3)}', 'd')}, substr('!@#$%^&*.?', 1 + {spin('py', 10)}, {spin('pz', 2)}), upper({text(wide, f'{spin("pu", 4)} + 1', 'u')}))"
    hash_ = text(hexes, f"32 + 8 * {spin('ck', 2)}", "c")
    kinds = [
        (text(hexes, "40", "h"), secret_word, mark, some_after, 1),
        (text(hexes, f"32 + 16 * {spin('hl', 3)}", "h"), secret_word, mark, some_after, 1),
        (text(wide, f"20 + {spin('bl', 45)}", "b"), secret_word, mark, some_after, 1),
        (text(wide + "+/", f"40 + {spin('bl', 45)}", "b"), any_word, mark, some_after, 1),
        (f"concat('AKIA', upper({text(wide, '16', 'a')}))", any_word, "' '", some_after, 1),
        (f"concat('ghp_', {text(wide, '36', 'g')})", any_word, mark, some_after, 1),
        (f"concat('sk_live_', {text(wide, '24', 's')})", any_word, "' '", some_after, 1),
        (f"concat('eyJ', {text(wide, '20', 'j')}, '.', 'eyJ', {text(wide + '_-', f'30 + {spin("jl", 60)}', 'k')}, '.', {text(wide + '_-', '43', 'l')})", any_word, "' '", some_after, 1),
        (hash_, any_word, "' '", secret_word, 1),
        (password, secret_word, mark, some_after, 1),
        (text(wide + "!@#$%^&*", f"8 + {spin('ql', 12)}", "q"), secret_word, mark, some_after, 1),
        (long_word, any_word, "' '", some_after, 0),
        (long_word, secret_word, "' '", some_after, 0),
        (f"concat('path/', {long_word}, '/', {long_word})", any_word, "' '", some_after, 0),
        (f"concat('www.', {long_word}, '.', {short_word}, '.org')", any_word, "' '", some_after, 0),
        (f"concat({short_word}, '.', {long_word}, '.', {short_word})", any_word, mark, some_after, 0),
        (f"concat(substr({short_word}, 1, 5), {spin('hn', 100)}, '.', {short_word}, get(array('.com','.org','.net','.de'), {spin('hd', 4)}))", any_word, "' '", some_after, 0),
        (f"concat({short_word}, '/', {short_word}, '/', {long_word}, '.html')", any_word, "' '", some_after, 0),
        (f"concat('your_', {long_word}, '_here_example')", secret_word, mark, some_after, 0),
        ("repeat('x', 20)", secret_word, mark, some_after, 0),
        (hash_, plain_word, "': '", some_after, 0),
        (hash_, any_word, "' '", plain_word, 0),
        (text("0123456789", f"16 + {spin('nl', 4)}", "n"), any_word, "' '", some_after, 0),
        (f"concat({long_word}, '-', {long_word})", any_word, "' '", some_after, 0),
        (f"get(array('required','undefined','optional','changeme','example','string','os.environ','process.env','settings.py','Bearer','integer','function'), {spin('pv', 12)})", secret_word, mark, some_after, 0),
        (short_word, secret_word, mark, some_after, 0),
        (long_word, secret_word, mark, some_after, 0),
        (f"concat({short_word}, '.', {short_word}, '.', {short_word})", secret_word, mark, some_after, 0),
        ("repeat(get(array('=','-','_'), " + spin("r", 3) + f"), 16 + {spin('rl', 60)})", any_word, "' '", some_after, 0),
    ]
    kind = f"case {spin('kind', len(kinds))} " + " ".join(f"when {i} then struct({c} as candidate, {b} as before, {m} as marks, {f} as after, {label} as label)" for i, (c, b, m, f, label) in enumerate(kinds)) + " end"
    return spark.range(0, rows, 1, 4).select(F.expr(kind).alias("k"), F.expr(path).alias("path")).select("k.candidate", "k.before", F.expr("if(k.before = '', '', k.marks)").alias("marks"), "k.after", "path", "k.label")


def forest(labelled: DataFrame) -> str:
    """SQL for the forest's probability of a secret, over an array of features named f."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select(array_to_vector(F.expr(features("candidate", "before", "marks", "after", "path"))).alias("features"), F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(rows)

    def sql(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-12):.6f}D"
        split = node.split()
        return f"if(get(f, {split.featureIndex()}) <= {split.threshold()!r}D, {sql(node.leftChild())}, {sql(node.rightChild())})"

    return "(" + " + ".join(sql(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode()) for t in model.trees) + f") / {len(model.trees)}D"


def held_out(labelled: DataFrame, folds: int = 5) -> dict[str, float]:
    """Precision and recall of a forest trained without one of `folds` parts, on that part."""
    part = F.pmod(F.xxhash64("candidate", "before", "marks", "after"), F.lit(folds))
    probability = forest(labelled.where(part != 0))
    rows = labelled.where(part == 0).select("label", F.expr(features("candidate", "before", "marks", "after", "path")).alias("f")).select("label", (F.expr(probability) >= CUT).cast("int").alias("said"))
    n = rows.agg(F.sum(F.col("label") * F.col("said")).alias("both"), F.sum("said").alias("said"), F.sum("label").alias("label")).first()
    return {"precision": n["both"] / max(1, n["said"]), "recall": n["both"] / max(1, n["label"])}


def _parts(run: str, around: str) -> str:
    """SQL for the candidates (secret, around) of a run: the run itself if no `=` stands before
    other characters of it, else its parts that are long enough, each behind the part before it
    and `=`. A part behind a `=` that is too short by itself leaves the whole run a candidate too.
    Of what holds dots, the pieces between them that are long enough are candidates too.
    """
    long = f"length(p) >= {SHORTEST}"
    first = f"right(concat({around}, regexp_extract({run}, '^=+', 0)), {AROUND})"
    behind = f"right(concat(get(q, i - 1), '='), {AROUND})"
    whole = f"array(struct({run} as secret, {around} as around))"
    parts = f"transform(q, (p, i) -> struct(p as secret, if(i = 0, {first}, {behind}) as around))"
    short = f"not exists(q, p -> {long}) or exists(slice(q, 2, greatest(size(q) - 1, 0)), p -> not {long})"
    cut = f"if({run} rlike '=[^=]', transform(array(regexp_extract_all({run}, '{PART}', 0)), q -> concat({parts}, if({short}, {whole}, slice({whole}, 1, 0))))[0], {whole})"
    dotted = "flatten(transform(z, y -> if(contains(y.secret, '.'), transform(split(y.secret, '[.]'), (p, i) -> struct(p as secret, if(i = 0, y.around, '') as around)), slice(array(y), 1, 0))))"
    return f"filter(transform(array({cut}), z -> concat(z, {dotted}))[0], y -> length(y.secret) >= {SHORTEST})"


def _candidates(token: str, around: str) -> str:
    """SQL for the candidates of a token: the value that a name announces, or those of a run."""
    value = f"array(struct(regexp_extract({token}, r'^{VALUE}$', 3) as secret, right(concat(regexp_extract({token}, r'^{VALUE}$', 1), regexp_extract({token}, r'^{VALUE}$', 2)), {AROUND}) as around))"
    return f"if({token} rlike r'^{VALUE}$', {value}, {_parts(token, around)})"


def _found(text: Column, path: Column, probability: str) -> list[tuple[str, Column]]:
    """Columns to add one after the other: tokens and gaps, candidates with their surroundings,
    then with a score."""
    ctx = f"concat(x.secret, ' ', regexp_extract(x.after, r'{AFTER}', 1), ' ', regexp_extract(x.around, r'{BEFORE}', 0))"
    return [
        ("__t", F.coalesce(text, F.lit(""))),
        ("__p", F.coalesce(path, F.lit(""))),
        ("__r", F.regexp_extract_all("__t", F.lit(TOKEN), F.lit(0))),
        ("__g", F.expr(f"split(__t, r'{TOKEN}', -1)")),
        # what stands before each token: the end of the one before it, and the gap; and behind it
        ("__a", F.expr(f"zip_with(concat(array(''), __r), __g, (r, gap) -> right(concat(r, gap), {AROUND}))")),
        ("__n", F.expr(f"zip_with(__g, concat(__r, array('')), (gap, r) -> left(concat(gap, r), {AROUND}))")),
        ("__b", F.expr("zip_with(__r, zip_with(slice(__a, 1, size(__r)), slice(__n, 2, size(__r)), (a, n) -> struct(a, n)), (r, x) -> struct(r as token, x.a as around, x.n as after))")),
        ("__e", F.expr(f"flatten(transform(__b, (x, i) -> transform({_candidates('x.token', 'x.around')}, y -> struct(y.secret as secret, y.around as around, if(endswith(x.token, y.secret), x.after, '') as after, i as i))))")),
        # each distinct context once, as one text: neither a candidate nor the word behind it holds a blank
        ("__c", F.expr(f"array_distinct(transform(__e, x -> {ctx}))")),
        ("__d", F.expr("transform(__c, c -> struct(substring_index(c, ' ', 1) as secret, split(c, ' ', 3)[1] as after, split(c, ' ', 3)[2] as around))")),
        ("__x", F.expr(f"transform(__d, x -> struct(x.secret as secret, x.after as after, regexp_extract(x.around, r'{BEFORE}', 1) as before, regexp_extract(x.around, r'{BEFORE}', 2) as marks))")),
        ("__f", F.expr(f"transform(__x, x -> struct(x.secret as secret, x.before as before, x.after as after, {features('x.secret', 'x.before', 'x.marks', 'x.after', '__p')} as f))")),
        ("__y", F.expr(f"sort_array(transform(__f, (x, i) -> struct(x.secret as secret, - transform(array(x.f), f -> {probability})[0] as under, i as i, x.before as before, x.after as after)))")),
        # of a candidate's contexts the one with the highest score, the first of them
        ("__z", F.expr("filter(__y, (x, i) -> i = 0 or x.secret <> get(__y, i - 1).secret)")),
        ("__s", F.expr("transform(sort_array(transform(__z, x -> struct(x.i as i, x as x))), y -> struct(y.x.secret as secret, y.x.before as before, y.x.after as after, - y.x.under as score))")),
    ]


def _places() -> list[tuple[str, Column]]:
    """Columns for the code points before each token: lengths are summed in blocks of 256, so that
    a finding's place costs a block and the number of blocks, not all tokens before it."""
    return [
        ("__l", F.expr("if(size(__k) = 0, cast(array() as array<bigint>), zip_with(__r, slice(__g, 1, size(__r)), (r, g) -> cast(length(r) + length(g) as bigint)))")),
        ("__m", F.expr("if(size(__l) = 0, cast(array() as array<bigint>), transform(sequence(0, size(__l) div 256), k -> aggregate(slice(__l, cast(256 * k + 1 as int), 256), 0L, (n, x) -> n + x)))")),
        ("__w", F.expr("transform(__k, x -> struct(x as x, element_at(filter(__e, e -> e.secret = x.secret), 1).i as i))")),
    ]


_BEFORE_TOKEN = "aggregate(slice(__m, 1, cast(y.i div 256 as int)), 0L, (n, x) -> n + x) + aggregate(slice(__l, cast(256 * (y.i div 256) + 1 as int), y.i % 256), 0L, (n, x) -> n + x) + length(get(__g, y.i))"


def scan(docs: DataFrame, path: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """docs with candidates (secret, before, after, score; each distinct one once), findings (those
    with a score of CUT or more, with `at`, the code points before the first candidate of that text)
    and redacted, the text with findings masked. A candidate is scored in each distinct context in
    which it stands; before, after and score are those of the highest score.

    A finding of SHORTEST characters or more is masked wherever its characters stand, a shorter one
    where a name announces it. path names a column that holds a document's path. Null texts have
    no candidates and stay null; an empty table gives an empty result; repeated rows each get
    their result; very long texts are looked at whole. Columns of docs that carry a name of the
    result give way to it.
    """
    spark = docs.sparkSession
    probability = forest(labelled if labelled is not None else findings(spark))
    own = [c for c in docs.columns if c not in ("candidates", "findings", "redacted")]
    df = docs.select(F.struct(*[docs[c] for c in own]).alias("__own"), docs["text"].cast("string").alias("__text"), (docs[path] if path else F.lit("")).cast("string").alias("__path"))
    for name, column in _found(F.col("__text"), F.col("__path"), probability):
        df = df.withColumn(name, column)
    none = "cast(array() as array<struct<secret: string, before: string, after: string, score: double>>)"
    df = df.withColumn("__s", F.expr(f"coalesce(__s, {none})"))
    # longer ones first: one secret may be part of another
    df = df.withColumn("__k", F.expr("array_sort(filter(__s, x -> x.score >= " + str(CUT) + "D), (a, b) -> case when length(a.secret) > length(b.secret) then -1 when length(a.secret) < length(b.secret) then 1 when a.secret < b.secret then -1 when a.secret > b.secret then 1 else 0 end)"))
    for name, column in _places():
        df = df.withColumn(name, column)
    # a value gives way at its own place, in the token that holds it; then long ones give way everywhere
    value = f"regexp_extract(r, r'^{VALUE}$', 3)"
    masked = f"if(r rlike r'^{VALUE}$' and exists(__k, x -> x.secret = {value}), concat(left(r, length(r) - length({value})), '{MASK}'), r)"
    joined = f"array_join(zip_with(__g, concat(transform(__r, r -> {masked}), array('')), (g, r) -> concat(g, r)), '')"
    return df.select(
        "__own.*",
        F.col("__s").alias("candidates"),
        F.expr(f"transform(__w, y -> struct(y.x.secret as secret, y.x.before as before, y.x.after as after, y.x.score as score, {_BEFORE_TOKEN} + if(endswith(get(__r, y.i), y.x.secret), length(get(__r, y.i)) - length(y.x.secret), instr(get(__r, y.i), y.x.secret) - 1) as at))").alias("findings"),
        F.expr(f"case when size(__k) = 0 then __text else aggregate(filter(__k, x -> length(x.secret) >= {SHORTEST}), {joined}, (t, x) -> replace(t, x.secret, '{MASK}')) end").alias("redacted"),
    )


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with its secrets masked in text, and n_chars (where docs has it) counted anew."""
    found = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), (docs[path] if path else F.lit("")).alias("path")), "path")
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
