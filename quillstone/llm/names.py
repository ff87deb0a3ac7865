"""Variant spellings of names typed by people.

Method: trie join. Every distinct spelling is reduced to a key: titles, roles, brackets, accents,
case, separators and middle initials go, and the tokens are put in one order, so spellings that
differ in these only share a key: "family, given" and "family I" are turned round as they stand,
and a person of two words without a comma is checked in both orders, the corpus showing on which
side its words are families and given names. Keys are then sharded by what
two keys within one edit must have in common (two of their three parts); each shard's keys form a
trie, which is traversed with a Levenshtein automaton (with transpositions) to enumerate neighbours
within distance one; an initial is never taken for another one's error. A key follows its
best-supported neighbour, and that one its own, to the end. A shard of very many keys, such as those
of a common given name, is sharded again by what is left of a key without one of its characters; so
many keys have that in common as there are places and characters, whatever the collection's size.

What is left are forms that no small distance reaches; they are looked up under the same family
name, where relatives are told apart: a nickname stands for a given name of the fixed table or for
one that the corpus itself shows under the same families far beyond chance; an initial, or a family
name alone, stands for the only given name that fits. Where two persons of the family fit, nothing
is linked. Abbreviated bodies are looked up by their place and their words' first letters, and
every abbreviation has to begin the word it stands for.

All spellings of one entity are one class; ``variant_pairs`` links them with each other. The distinct spellings are aggregated
before anything is shuffled, so a name on a third of all rows is one row here.

Cases: null, empty and blank names are ignored; names are compared exactly as written and a pair is
given once, smaller first; a name that is all titles and punctuation has no key and no pairs; keys
under five characters are linked by equality only.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.arrow import batch_of, partitions_for
from quillstone.storage import cut

# Words around a name that are not part of it.
BEFORE = {"by", "the", "dr", "prof", "professor", "mr", "mrs", "ms", "sir", "rev"}
AFTER = {"phd", "ma", "md", "ba", "msc", "jr", "sr", "ed", "eds", "editor", "editors", "author", "trans", "translator", "esq"}
ROLES_ZH = ("编著", "主编", "编译", "等著", "著", "译", "编")
# Common English short forms and the names they stand for.
NICKNAMES = {
    "alex": "alexandra alexander", "andy": "andrew", "beth": "elizabeth", "bella": "isabella", "ben": "benjamin", "bill": "william",
    "bob": "robert", "cathy": "catherine", "charlie": "charlotte charles", "dan": "daniel", "dave": "david", "dot": "dorothea dorothy",
    "dotty": "dorothea dorothy", "ed": "edward", "eddie": "edward", "etta": "henrietta", "fred": "frederick", "freddie": "frederick",
    "greg": "gregory", "hattie": "henrietta", "izzy": "isabella", "jim": "james", "jo": "josephine", "joe": "joseph", "josie": "josephine",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "len": "leonard", "lenny": "leonard", "leo": "leonard",
    "liz": "elizabeth", "lizzie": "elizabeth", "lottie": "charlotte", "maggie": "margaret", "meg": "margaret", "mike": "michael",
    "mick": "michael", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nick": "nicholas", "peggy": "margaret", "quin": "quentin",
    "rob": "robert", "ron": "ronald", "sam": "samuel", "sandra": "alexandra", "sue": "susannah susan", "susie": "susannah susan",
    "ted": "edward theodore", "thea": "dorothea theodora", "theo": "theodore", "tom": "thomas", "tony": "anthony", "tori": "victoria",
    "uli": "ulrich", "vicky": "victoria", "will": "william", "yoli": "yolanda",
}

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|〔[^〔〕]*〕")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_SPLIT = re.compile(r"[\W_]+")
_PARSED = pa.schema([(c, pa.string()) for c in ("name", "key", "script", "given", "family", "place", "letters", "words", "turned")])


def parse(name: str) -> dict[str, str] | None:
    """Key and parts of a spelling; None if nothing is left of it.

    given and family are set for what looks like a person (given may be one letter, or empty for a
    family name alone), place, letters and words for what looks like a body of several words. turned
    is the key in the other order of given and family, empty where the spelling shows the order."""
    text = unicodedata.normalize("NFKC", name).strip()
    bare = _BRACKETS.sub(" ", text).strip()
    text = bare if _SPLIT.sub("", bare) else text
    if _CJK.search(text):
        for role in ROLES_ZH:
            stem = text[: -len(role)].rstrip()
            if text.endswith(role) and len(stem) < len(text) - len(role):
                text = stem
                break
        halves = [x for x in text.split(",") if x.strip()]
        if len(halves) == 2:
            text = f"{halves[1]} {halves[0]}"
        tokens = [t.lower() for t in _SPLIT.split(text) if t]
        if not tokens:
            return None
        out = {"key": "".join(tokens), "script": "zh", "given": "", "family": "", "place": "", "letters": "", "words": "", "turned": ""}
        if len(tokens) == 2 and re.fullmatch("[a-z]", tokens[1]) and len(halves) != 2 and "《" not in text:
            out |= {"key": tokens[1] + tokens[0], "given": tokens[1], "family": tokens[0]}
        elif len(tokens) == 2 and _CJK.search(tokens[1]) and "《" not in text:
            out |= {"given": tokens[0], "family": tokens[1]}
            if len(halves) != 2 and _CJK.search(tokens[0]) and tokens[0] != tokens[1]:
                out["turned"] = tokens[1] + tokens[0]
        elif len(tokens) == 1 and len(tokens[0]) <= 4 and "《" not in text:
            out["family"] = tokens[0]
        return out
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    parts = [[t for t in re.split(r"[^\w.]+", p) if t.strip("._")] for p in text.split(",")]
    parts = [p for p in parts if p]
    # "Name, PhD" has a name of two words before the comma; "Name, Ed" has a given name after it
    while len(parts) > 1 and sum(map(len, parts[:-1])) > 1 and all(t.lower().replace(".", "") in AFTER for t in parts[-1]):
        parts.pop()
    raw = [t for p in reversed(parts) for t in p] if len(parts) == 2 else [t for p in parts for t in p]
    # "B.J." is two initials, "M.A." after the name a degree
    raw = [x for t in raw for x in (t.split(".") if re.fullmatch(r"(\w\.)+\w?\.?", t) else [t]) if x]
    if len(raw) == 1:  # "AnthonyNumofovik"
        raw = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", raw[0]).split()
    while len(raw) > 1 and raw[0].lower().strip(".") in BEFORE:
        raw = raw[1:]
    while len(raw) > 2 and raw[-1].lower().strip(".") in AFTER:
        raw = raw[:-1]
    tokens = [t.lower().replace(".", "") for t in raw]
    dotted = [t.endswith(".") and len(t) > 3 for t in raw]
    if not any(tokens):
        return None
    out = {"key": "".join(tokens), "script": "la", "given": "", "family": "", "place": "", "letters": "", "words": "", "turned": ""}
    rest = [t for t in tokens[1:] if len(t) > 1]
    if len(tokens) > 1 and len(rest) == 1 and not any(dotted):
        out |= {"key": tokens[0] + rest[0], "given": tokens[0], "family": rest[0]}
        if len(parts) != 2 and len(tokens[0]) > 1 and tokens[0] != rest[0]:
            out["turned"] = rest[0] + tokens[0]
    elif 1 < len(tokens) < 4 and len(tokens[0]) > 1 and not rest and tokens[1] and len(parts) != 2:  # "Numofovik A"
        out |= {"key": tokens[1] + tokens[0], "given": tokens[1], "family": tokens[0]}
    elif len(tokens) == 1:
        out["family"] = tokens[0]
    elif len(tokens) > 2:
        major = [t for t in tokens[1:] if t not in ("of", "for", "and", "the")]
        out |= {"place": tokens[0], "letters": "".join(t[0] for t in major), "words": " ".join(major)}
        if any(dotted):
            out["key"] = "~" + out["key"]  # abbreviations are looked up, not compared by distance
    return out


def shard_keys(key: str) -> list[str]:
    """What ``key`` shares with every key within one edit of it: for each length class, its ends, its
    beginning, or its end (an edit leaves one of the three whole)."""
    out = []
    for c in (len(key) - 1, len(key)):
        t, long = (c - 1) // 3, c - 1 - (c - 1) // 3
        out += [f"{c}e{key[:t]}|{key[len(key) - t:]}", f"{c}b{key[:long]}", f"{c}s{key[len(key) - long:]}"]
    return out


def without_one(key: str) -> set[str]:
    """The key, and the key less any one character; keys within one edit have one of these in common."""
    return {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))}


class Trie:
    def __init__(self, keys: list[str]):
        self.root: dict = {}
        for k in keys:
            node = self.root
            for c in k:
                node = node.setdefault(c, {})
            node[""] = k

    def within(self, key: str, bound: int = 1) -> list[str]:
        """Keys at a distance of at most ``bound``: the automaton's state is a row of the edit-distance
        table, one step per edge of the trie; a state without an entry in reach is dead."""
        found, n = [], len(key)
        stack = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            if "" in node and row[n] <= bound:
                found.append(node[""])
            for c, child in node.items():
                if c == "":
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (key[j - 1] != c))
                    if before is not None and j > 1 and key[j - 1] == last and key[j - 2] == c:
                        d = min(d, before[j - 2] + 1)
                    new.append(d)
                if min(new) <= bound:
                    stack.append((child, new, row, c))
        return found


def substituted(a: str, b: str) -> tuple[str, str] | None:
    """The two characters if a and b differ by one substitution."""
    if len(a) != len(b):
        return None
    at = [i for i in range(len(a)) if a[i] != b[i]]
    return (a[at[0]], b[at[0]]) if len(at) == 1 else None


def neighbours(keys: DataFrame, most: int = 2_000) -> DataFrame:
    """(a, b, x, y): keys of one script within one edit, a < b; x and y the characters of a substitution.

    Shards of more than ``most`` keys are sharded again."""

    def shard(batches):
        for batch in batches:
            ks, shards = [], []
            for key, script in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(key) >= 5 and key[0] != "~":
                    for s in shard_keys(key):
                        ks.append(key)
                        shards.append(f"{script}{s}")
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(ks, pa.string())], names=["shard", "key"])

    def join(batches):
        def finish(keys):
            trie = Trie(keys)
            for k in keys:
                for other in trie.within(k):
                    if k < other:
                        x, y = substituted(k, other) or (None, None)
                        yield k, other, x, y

        now, held, rows = None, [], []
        for batch in batches:
            for s, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    if len(held) > 1:
                        rows += finish(held)
                    now, held = s, []
                held.append(k)
            if rows:
                yield pairs_batch(rows)
                rows = []
        if len(held) > 1:
            rows += finish(held)
        yield pairs_batch(rows)

    def pairs_batch(rows):
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["a", "b", "x", "y"])

    def again(batches):
        for batch in batches:
            ks, shards = [], []
            for s, key, large in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = [f"{s}-{rest}" for rest in sorted(without_one(key))] if large else [s]
                shards += own
                ks += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.string()), pa.array(ks, pa.string())], names=["shard", "key"])

    shards = cut(keys.select("key", "script").distinct().mapInArrow(shard, "shard string, key string"), "name-shards")
    large = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("shard", F.lit(True).alias("large"))
    shards = shards.join(large, "shard", "left").select("shard", "key", F.coalesce("large", F.lit(False))).mapInArrow(again, "shard string, key string")
    # a fixed number of partitions: the rows are few bytes and much work, so they must not be merged
    partitions = partitions_for(keys.sparkSession, 0)
    return shards.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(join, "a string, b string, x string, y string").distinct()


def spellings(df: DataFrame, names: str) -> DataFrame:
    """(name, n, key, script, given, family, place, letters, words, turned) of every distinct spelling."""
    counted = df.select(F.explode(names).alias("name")).filter(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))

    def run(batches):
        for batch in batches:
            columns: dict[str, list] = {f.name: [] for f in _PARSED}
            counts = []
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed = parse(name)
                if parsed and parsed["key"]:
                    columns["name"].append(name)
                    counts.append(n)
                    for c, v in parsed.items():
                        columns[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), *batch_of(columns, _PARSED).columns], names=["n", *columns])

    return counted.mapInArrow(run, "n long, " + ", ".join(f"{f.name} string" for f in _PARSED))


def in_one_order(named: DataFrame) -> DataFrame:
    """``named`` without turned: persons typed with the family name first get the key and parts of the other order.

    Each order is as likely as the product of its words' uses on that side in other names; a name is turned
    where the other order is more than twice as likely. Where the corpus does not tell, a spelling follows the
    same two words in the other order, if they are there, unless all four uses occur: then both are persons."""
    persons = named.filter("family <> '' and given <> ''")
    orders = persons.groupBy("script", "given", "family").agg(
        F.first("key").alias("key"), F.max("turned").alias("turned"), F.bool_or(F.col("turned") == "").alias("certain"), F.sum("n").alias("n")
    )
    orders = cut(orders, "name-orders")
    alone = named.filter("family <> '' and given = ''").select("script", F.col("family").alias("word")).distinct()
    sides = (
        orders.select("script", F.col("family").alias("word"), F.lit(1).alias("f"), F.lit(0).alias("g"))
        .unionByName(alone.select("script", "word", F.lit(1).alias("f"), F.lit(0).alias("g")))
        .unionByName(orders.select("script", F.col("given").alias("word"), F.lit(0).alias("f"), F.lit(1).alias("g")))
        .groupBy("script", "word")
        .agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
    )
    sides = cut(sides, "name-sides")
    twin = orders.select("script", F.col("given").alias("family"), F.col("family").alias("given"), F.struct("certain", "n", "key").alias("twin"))
    first = sides.select("script", F.col("word").alias("given"), F.col("f").alias("fx"), F.col("g").alias("gx"))
    second = sides.select("script", F.col("word").alias("family"), F.col("f").alias("fy"), F.col("g").alias("gy"))
    judged = orders.filter("turned <> '' and not certain").join(twin, ["script", "given", "family"], "left").join(first, ["script", "given"]).join(second, ["script", "family"])
    # the name itself and the one in the other order are no evidence
    judged = judged.withColumn("t", F.col("twin").isNotNull().cast("long")).selectExpr(
        "*", "(gx - 1 + 0.5) * (fy - 1 + 0.5) as typed", "(gy - t + 0.5) * (fx - t + 0.5) as other", "gx > 1 and fy > 1 and gy > t and fx > t as both"
    )
    told = F.expr("other > 2 * typed")
    untold = F.expr("twin is not null and typed <= 2 * other and (twin.certain or not both and struct(twin.n, twin.key) > struct(n, key))")
    turned = judged.filter(told | untold).select("script", "given", "family", F.lit(True).alias("turn"))
    joined = named.join(turned, ["script", "given", "family"], "left").withColumn("turn", F.expr("turn is not null and turned <> ''"))
    pick = lambda a, b: F.when(F.col("turn"), F.col(b)).otherwise(F.col(a)).alias(a)
    return joined.select("name", "n", pick("key", "turned"), "script", pick("given", "family"), pick("family", "given"), "place", "letters", "words")


def roots_by_distance(named: DataFrame) -> DataFrame:
    """(key, root): each key with the best-supported key within one edit, itself if it is that.

    In a script of many characters two different names are often one character apart; there a
    substitution counts as an error only if one of the two characters is rare against the other."""
    keys = cut(
        named.groupBy("key").agg(
            F.first("script").alias("script"), F.count("*").alias("forms"), F.sum("n").alias("n"), F.max(F.when(F.expr("given rlike '^[a-z]$'"), F.col("given")).otherwise("")).alias("initial")
        ),
        "name-keys",
    )
    chars = (
        keys.filter("script = 'zh'").select(F.explode(F.split("key", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("f"))
    )
    near = neighbours(keys)
    near = (
        near.join(F.broadcast(chars.select(F.col("c").alias("x"), F.col("f").alias("fx"))), "x", "left")
        .join(F.broadcast(chars.select(F.col("c").alias("y"), F.col("f").alias("fy"))), "y", "left")
        .filter("fx is null or fy is null or greatest(fx, fy) >= 6 * least(fx, fy)")
        .select("a", "b", F.coalesce(F.col("fx") - F.col("fy"), F.lit(0)).alias("usual"))
    )
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("usual")).alias("usual")))
    support = keys.select("key", "forms", "n", "initial")
    ranked = (
        both.join(support.select(F.col("key").alias("a"), F.col("forms").alias("fa"), F.col("n").alias("na"), F.col("initial").alias("ia")), "a")
        .join(support.select(F.col("key").alias("b"), F.col("forms").alias("fb"), F.col("n").alias("nb"), F.col("initial").alias("ib")), "b")
        # "W. Ohm" is not "H. Ohm", nor "Ohm" with an error
        .filter("ia = ib")
        # the spelling with the usual character, then with more forms, then with more uses leads
        .filter("struct(-usual, fb, nb, b) > struct(0L, fa, na, a) and (usual <= 0)")
        .groupBy("a")
        .agg(F.max(F.struct(-F.col("usual"), "fb", "nb", "b")).alias("to"))
        .select(F.col("a").alias("key"), F.col("to.b").alias("parent"))
    )
    step = cut(keys.select("key", "script").join(ranked, "key", "left").select("key", "script", F.coalesce("parent", "key").alias("root")), "name-roots")
    # an error's root may itself follow a better key: each round doubles the steps taken, to 64 at most
    for _ in range(6):
        up = step.select(F.col("key").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(up, "root").select("key", "script", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "name-roots")
        if not step.filter("moved").head(1):
            break
    return step.select("key", "root")


def usual_names(leads: DataFrame) -> dict[str, list[str]]:
    """Given names of at least one family in 200, so at most 200 of a script."""
    counts = leads.groupBy("script", "given").agg(F.count("*").alias("families"))
    total = leads.groupBy("script").agg(F.count("*").alias("all"))
    rows = counts.join(F.broadcast(total), "script").filter("families >= greatest(3, 0.005 * all)").select("script", "given").collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows):
        found.setdefault(r["script"], []).append(r["given"])
    return found


def misspelt(givens: DataFrame, usual: dict[str, list[str]]) -> DataFrame:
    """(script, given, meant): rare Latin given names of five letters or more within one edit of a single usual one."""
    schema = pa.schema([(c, pa.string()) for c in ("script", "given", "meant")])

    def run(batches):
        known = set(usual.get("la", ()))
        trie = Trie(sorted(known))
        for batch in batches:
            out: dict[str, list] = {"script": [], "given": [], "meant": []}
            for script, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = trie.within(given) if script == "la" and len(given) > 4 and given not in known else []
                if len(near) == 1:
                    out["script"].append(script)
                    out["given"].append(given)
                    out["meant"].append(near[0])
            yield batch_of(out, schema)

    return givens.filter("given not in ('')").mapInArrow(run, "script string, given string, meant string")


def variant_groups(df: DataFrame, names: str) -> DataFrame:
    """(name, entity): the entity of every distinct spelling, named by one of its keys."""
    named = cut(in_one_order(cut(spellings(df, names), "spellings")), "ordered")
    rooted = cut(named.join(roots_by_distance(named), "key"), "rooted")
    persons = rooted.filter("family <> '' and given <> ''")
    full = persons.filter("length(given) > 1 or (script = 'zh' and not given rlike '^[a-z]$')")
    # given names by the root's own parts, so that an error is not a second person of the family
    leads = full.filter("key = root").select("script", "given", "family", "root").distinct()
    leads = cut(leads, "leads")
    usual = usual_names(leads)
    errors = cut(misspelt(leads.select("script", "given").distinct(), usual), "given-errors")
    leads = leads.join(errors, ["script", "given"], "left").select("script", F.coalesce("meant", "given").alias("given"), "family", "root").distinct()
    leads = cut(leads, "meant-leads")
    usage = leads.groupBy("script", "given").agg(F.count("*").alias("families"))
    total = leads.groupBy("script").agg(F.count("*").alias("all"))
    usage = cut(usage.join(F.broadcast(total), "script").withColumn("usual", F.expr("families >= greatest(3, 0.005 * all)")), "given-usage")

    # nicknames: the fixed table, and rare given names that share their families with a usual one
    fixed = [(k, v) for k, vs in NICKNAMES.items() for v in vs.split()]
    fixed = df.sparkSession.createDataFrame(fixed, "given string, formal string").withColumn("script", F.lit("la"))
    rare = leads.join(usage.filter("not usual and families >= 3").select("script", "given", "families"), ["script", "given"])
    usual = leads.join(usage.filter("usual").select("script", F.col("given")), ["script", "given"])
    usual = usual.select("script", "family", F.col("given").alias("formal"))
    seen = rare.join(usual, ["script", "family"]).groupBy("script", "given", "formal").agg(F.count("*").alias("both"), F.first("families").alias("families"))
    mined = seen.filter("both >= 3 and both >= 0.3 * families").select("script", "given", "formal")
    nick = mined.unionByName(fixed.select("script", "given", "formal")).distinct()
    by_name = leads.select("script", "family", F.col("given").alias("formal"), F.col("root").alias("lead"))
    nicks = (
        leads.join(nick, ["script", "given"])
        .join(by_name, ["script", "family", "formal"])
        .groupBy("root")
        .agg(F.min("lead").alias("lead"), F.max("lead").alias("other"))
        .filter("lead = other and lead <> root")
        .select("root", "lead")
    )
    # a nickname and an error in the family name: the formal key is looked for within one edit
    formal_key = leads.join(nick, ["script", "given"]).join(nicks.select("root"), "root", "left_anti")
    formal_key = cut(formal_key.select("root", "script", F.concat("formal", "family").alias("formal_key")).filter("length(formal_key) >= 8"), "formal-keys")
    there = full.select("key", "script", F.col("root").alias("lead")).distinct()
    near = neighbours(there.select("key", "script").unionByName(formal_key.select(F.col("formal_key").alias("key"), "script")).distinct())
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.join(formal_key, F.col("a") == F.col("formal_key")).join(there.select(F.col("key").alias("b"), "lead"), "b").select("root", "lead")
    near = near.filter("lead <> root").groupBy("root").agg(F.min("lead").alias("lead"), F.max("lead").alias("other")).filter("lead = other")
    nicks = cut(nicks.unionByName(near.select("root", "lead")), "nicknames")
    people = leads.join(nicks.select("root"), "root", "left_anti")

    # initials: Latin names by their first letter; others by the letters the corpus shows for a given name
    initial = persons.filter("given rlike '^[a-z]$'").select("script", "given", "family", "root").distinct()
    only = people.groupBy("script", "family").agg(F.min("given").alias("formal"), F.max("given").alias("other")).filter("formal = other")
    shown = initial.join(only, ["script", "family"]).filter("script <> 'la'").groupBy("script", "given", "formal").agg(F.count("*").alias("both"))
    shown = shown.withColumn("all", F.sum("both").over(Window.partitionBy("script", "given")))
    letters = shown.filter("both >= 3 and both >= 0.15 * all").select("script", F.col("given").alias("letter"), F.col("formal").alias("given"))
    letters = cut(letters, "letters")
    lettered = people.filter("script = 'la'").join(nick, ["script", "given"], "left")
    lettered = lettered.select("script", "family", "root", F.substring(F.coalesce("formal", "given"), 1, 1).alias("letter")).distinct()
    lettered = lettered.unionByName(people.join(F.broadcast(letters), ["script", "given"]).select("script", "family", "root", "letter"))
    lettered = lettered.groupBy("script", "family", "letter").agg(F.min("root").alias("lead"), F.max("root").alias("other")).filter("lead = other")
    by_letter = initial.withColumnRenamed("given", "letter").join(lettered, ["script", "family", "letter"]).select("root", "lead")
    known = letters.select("script", F.col("letter").alias("given")).distinct()
    single = people.groupBy("script", "family").agg(F.min("root").alias("lead"), F.max("root").alias("other")).filter("lead = other")
    unknown = initial.filter("script <> 'la'").join(F.broadcast(known), ["script", "given"], "left_anti").join(single, ["script", "family"]).select("root", "lead")

    # a family name alone
    alone = rooted.filter("family <> '' and given = ''").select("script", "family", "root").distinct()
    alone = alone.join(single, ["script", "family"]).select("root", "lead")

    # abbreviated bodies
    bodies = rooted.filter("place <> ''")
    short = bodies.filter("key like '~%'").select("place", "letters", "words", "root")
    whole = bodies.filter("not key like '~%'").select("place", "letters", F.col("words").alias("full"), F.col("root").alias("lead")).distinct()
    fits = F.forall(F.arrays_zip(F.split("words", " ").alias("w"), F.split("full", " ").alias("f")), lambda x: x["f"].startswith(x["w"]))
    short = short.join(whole, ["place", "letters"]).filter(fits).select("root", "lead")

    links = by_letter.unionByName(unknown).unionByName(alone).unionByName(short).filter("root <> lead").unionByName(nicks)
    links = links.groupBy("root").agg(F.min("lead").alias("lead"), F.max("lead").alias("other")).filter("lead = other").select("root", "lead")
    up = nicks.select(F.col("root").alias("lead"), F.col("lead").alias("next"))
    links = links.join(up, "lead", "left").select("root", F.coalesce("next", "lead").alias("lead"))
    return rooted.join(links, "root", "left").select("name", F.coalesce("lead", "root").alias("entity"))


def variant_classes(df: DataFrame, names: str) -> DataFrame:
    """(name, class_name): every distinct spelling with the first spelling of its class by code point."""
    groups = cut(variant_groups(df, names), "name-groups")
    return groups.join(groups.groupBy("entity").agg(F.min("name").alias("class_name")), "entity").select("name", "class_name")


def variant_pairs(df: DataFrame, names: str) -> DataFrame:
    """(a, b), a < b: two spellings of one entity, exactly as written."""
    groups = variant_classes(df, names)
    x, y = groups.select("class_name", F.col("name").alias("a")), groups.select("class_name", F.col("name").alias("b"))
    return x.join(y, "class_name").filter("a < b").select("a", "b").distinct()
