"""Problem 6: spellings of one author or collaboration linked.

Method: a prefix-filtered set-similarity join on the q-grams of family names proposes misspelt family
names; a soft token similarity, in which rare tokens weigh more, verifies them. Collaborations meet on the
heavy tokens of their names and are verified alike, so a rare word outweighs what many of them share and
abbreviations count as soft matches. Within one family name and initial, given names, initials and
nicknames are reconciled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.llm.linkage import _near

#: Short forms and the given name they stand for.
NICKNAMES = dict(p.split(":") for p in """abby:abigail al:albert alex:alexander alf:alfred andy:andrew tony:anthony art:arthur barb:barbara becky:rebecca ben:benjamin bernie:bernard bert:albert beth:elizabeth betty:elizabeth bill:william billy:william bob:robert bobby:robert brad:bradley cathy:catherine chas:charles charlie:charles chuck:charles chris:christopher cindy:cynthia dan:daniel danny:daniel dave:david deb:deborah debbie:deborah dick:richard dolly:dorothea don:donald doug:douglas dot:dorothy dottie:dorothea dora:dorothea ed:edward eddie:edward edw:edward ned:edward ted:theodore teddy:theodore theo:theodore fran:frances frank:francis fred:frederick freddy:frederick gabe:gabriel gene:eugene geo:george geoff:geoffrey ginny:virginia greg:gregory hal:harold hank:henry harry:henry jack:john jake:jacob jamie:james jas:james jim:james jimmy:james jeff:jeffrey jen:jennifer jenny:jennifer jerry:gerald jo:josephine josie:josephine joe:joseph joey:joseph jos:joseph jon:jonathan josh:joshua judy:judith kate:katherine kathy:katherine katie:katherine kit:katherine kitty:katherine ken:kenneth kim:kimberly larry:lawrence len:leonard leo:leonard liz:elizabeth lizzie:elizabeth eliza:elizabeth lou:louis lucy:lucia maggie:margaret meg:margaret peg:margaret peggy:margaret greta:greta marge:margaret mandy:amanda matt:matthew max:maximilian mick:michael mike:michael mickey:michael molly:mary nancy:anne nate:nathaniel nell:eleanor nick:nicholas nicky:nicholas nic:nicholas pam:pamela pat:patricia patty:patricia tricia:patricia trish:patricia pete:peter phil:philip polly:mary ray:raymond rich:richard rick:richard rob:robert robbie:robert robt:robert ron:ronald russ:russell ruth:ruth sally:sarah sam:samuel saml:samuel sandy:alexander alec:alexander sasha:alexander stan:stanley steve:stephen sue:susan susie:susan suzy:susan terry:terence thos:thomas tom:thomas tommy:thomas tim:timothy tina:christina toby:tobias val:valerie vic:victoria vicky:victoria vickie:victoria tori:victoria vik:viktor vince:vincent wally:walter walt:walter wes:wesley will:william willie:william wm:william wim:william zach:zachary ollie:oliver quent:quentin paula:paula pasha:pavel yura:yuri becca:rebecca becks:rebecca reb:rebecca dorrie:dorothea thea:dorothea xen:xenia hughie:hugo ursa:ursula lily:leila carmie:carmen benj:benjamin benny:benjamin ozzie:oscar""".split())
#: Words of collaboration names that tell no two of them apart.
GENERIC = ("collaboration", "collaborations", "survey", "collab", "coll", "consortium", "team", "group", "project", "the", "for", "of")
_MARKS = ("collaboration", "collab", "coll", "consortium", "team", "project")
Q = 3
KIND_SCHEMA = "name string, kind string, family string, other string, given string, dotted boolean, mids string"


def parse(name: str, fold_name: str) -> tuple[str, str, str, str, bool, str]:
    """``kind, family, other, given, dotted, middle initials``; kind ``two`` leaves the order of two full words open."""
    toks = re.findall(r"[^\W\d_][\w'’-]*\.?|,", fold_name.replace("..", "."))
    words = [t for t in toks if t != ","]
    bare = [w.rstrip(".") for w in words]
    if any(_is_generic(w, _MARKS) for w in bare):
        core = sorted(w for w in bare if not _is_generic(w, GENERIC))
        return "group", " ".join(core), "", "", False, ""
    if not words:
        return "none", "", "", "", False, ""
    flat: list[tuple[str, bool]] = []

    def rest(parts: list[str]) -> tuple[str, bool, str]:
        flat.clear()
        for t in parts:
            b = t.rstrip(".")
            if re.fullmatch(r"(?:\w-)*\w", b) and "-" in b:
                flat.extend((x, True) for x in b.split("-"))
            elif b:
                flat.append((b, t.endswith(".")))
        if not flat:
            return "", False, ""
        return flat[0][0], flat[0][1] and len(flat[0][0]) > 1, "".join(x[0] for x, _ in flat[1:])

    if "," in toks:
        k = toks.index(",")
        head, tail = [t for t in toks[:k]], [t for t in toks[k + 1 :] if t != ","]
        return "comma", " ".join(t.rstrip(".") for t in head), "", *rest(tail)
    full = [i for i, b in enumerate(bare) if len(b) > 1 and not words[i].endswith(".")]
    if len(full) == 1 and len(words) > 1:
        i = full[0]
        return "initials", bare[i], "", *rest(words[:i] + words[i + 1 :])
    if len(full) >= 2:
        first, last = full[0], full[-1]
        middle = "".join(b[0] for i, b in enumerate(bare) if i not in (first, last))
        return "two", bare[last], bare[first], bare[first], False, middle
    if not full:
        return "initials", max(bare, key=len), "", *rest([w for w in words if w.rstrip(".") != max(bare, key=len)])
    return "single", bare[full[0]], "", "", False, ""


def _is_generic(w: str, known: tuple[str, ...]) -> bool:
    return w in known or len(w) > 8 and any(len(k) > 8 and _near(w, k, 1) for k in known)


#: Credit of a word for its abbreviation, letters that such has at least, and the share of its readings one must hold to be meant.
SHORTENED, STEM, MEANT = 0.8, 4, 0.8
#: Weight at most of a generic word or its abbreviation, and at least of any word.
LIGHT = 0.3
#: Similarity that verifies a misspelt family name and a collaboration.
SAME, SAME_GROUP = 0.8, 0.6
#: A family name of so many spellings, and not so many times rarer than the other, is a name of its own, not a slip.
OWN, RARER = 4, 5


def likeness(x: str, y: str) -> float:
    """How alike two words are: equal or an initial 1, an abbreviation ``SHORTENED``, one slip less the shorter the words."""
    if x == y or (len(x) == 1 or len(y) == 1) and x[0] == y[0]:
        return 1.0
    short, long = sorted((x, y), key=len)
    if len(short) >= STEM and long.startswith(short):
        return max(SHORTENED, 1 - 1 / len(long) if len(long) - len(short) == 1 else 0.0)
    return 1 - 1 / len(long) if _near(x, y, 1) else 0.0


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float], like=likeness) -> float:
    """Weighted share of the tokens that have a like token on the other side; an initial is like its name."""
    if not a or not b:
        return 0.0
    got = total = 0.0
    for xs, ys in ((a, b), (b, a)):
        for x in xs:
            w = weight.get(x, 1.0)
            total += w
            got += w * max(like(x, y) for y in ys)
    return got / total


def token_weight(token: str, spellings: int, total: int) -> float:
    """Log of how rare a token is among ``total`` names; generic words and their abbreviations stay light."""
    w = max(LIGHT, math.log((1 + total) / spellings))
    return min(LIGHT, w) if _is_generic(token, GENERIC) or len(token) >= STEM and any(g.startswith(token) for g in GENERIC) else w


def _grams(df: DataFrame, col: str) -> DataFrame:
    """``col, gram``: the rarest q-grams of each word, enough that two words one slip apart share one."""
    grams = df.select(col).distinct().select(col, F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length({col}) + 2), i -> substring(concat('^^', {col}, '$$'), i, {Q}))"))).alias("gram"))
    return grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram").withColumn("r", F.row_number().over(Window.partitionBy(col).orderBy("df", "gram"))).where(f"r <= {Q + 2}").select(col, "gram")


def group_pairs(fams: DataFrame) -> DataFrame:
    """``initial, base, slip, n`` of the collaborations in ``fams`` (``family, initial, n``) that are one, ``base`` the more frequent.

    A pair of similarity ``SAME_GROUP`` has matched that share of the weight on one side at least, so it meets
    on one of that side's heavy tokens (prefix filter); like tokens are found among the distinct tokens first.
    """
    from lucerna.runtime import cut

    groups = fams.where("initial = '#'").select("family", "n")
    words = groups.select("family", F.explode(F.array_distinct(F.split("family", " "))).alias("t")).where("t <> ''")
    weigh = F.udf(token_weight, "double")
    vocab = cut(words.groupBy("t").agg(F.count("*").alias("df")).crossJoin(groups.agg(F.count("*").alias("total"))).select("t", "df", weigh("t", "df", "total").alias("w")))
    x, y = vocab.where("length(t) >= 5").select("t"), vocab.select("t", "df")
    gram = cut(_grams(x, "t"))
    slips = gram.toDF("t", "gram").join(gram.toDF("u", "gram"), "gram").where("t <> u and abs(length(t) - length(u)) <= 1").where(F.levenshtein("t", "u") <= 2).select("t", "u").distinct()
    stem = lambda c: F.substring(c, 1, STEM)
    longer = y.select(F.col("t").alias("u"), F.col("df").alias("uf"), stem("t").alias("s")).join(y.where(f"length(t) >= {STEM}").select("t", stem("t").alias("s")), "s").where("length(u) > length(t) and startswith(u, t)")
    # an abbreviation of several words means the one that nearly always stands there, else none
    meant = longer.withColumn("all", F.sum("uf").over(Window.partitionBy("t"))).where(f"uf >= {MEANT} * all").select("t", "u")
    like = cut(slips.union(meant).union(meant.select("u", "t")).union(y.select("t", F.col("t").alias("u"))).distinct())
    heavy = words.join(vocab, "t")
    order = Window.partitionBy("family").orderBy("w", F.desc("t"))
    heavy = heavy.withColumn("below", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.sum("w").over(Window.partitionBy("family")))
    prefix = heavy.where(f"below >= {SAME_GROUP} * whole - 1e-9").select("family", "t")
    met = prefix.join(like, "t").select(F.col("family").alias("x"), F.col("u").alias("t")).join(words, "t").where("x <> family").select(F.least("x", "family").alias("x"), F.greatest("x", "family").alias("y")).distinct()
    named = groups.join(heavy.groupBy("family").agg(F.collect_list(F.struct("t", "w")).alias("ws")), "family")
    kin = words.join(like.where("t <> u"), "t").groupBy("family").agg(F.collect_set(F.concat_ws(" ", "t", "u")).alias("kin"))
    named = cut(named.join(kin, "family", "left"))
    both = met.join(named.toDF("x", "xn", "xw", "xk"), "x").join(named.toDF("y", "yn", "yw", "yk"), "y")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y, xn, yn, xw, yw, xk in zip(b["x"], b["y"], b["xn"], b["yn"], b["xw"], b["yw"], b["xk"]):
                known = set(xk) if xk is not None else set()
                alike = lambda p, q: likeness(p, q) if p == q or f"{p} {q}" in known or f"{q} {p}" in known else 0.0  # noqa: B023, E731
                weight = {r["t"]: r["w"] for r in [*xw, *yw]}
                if soft_similarity([r["t"] for r in xw], [r["t"] for r in yw], weight, alike) >= SAME_GROUP:
                    base, slip, n = (x, y, xn) if (-xn, x) < (-yn, y) else (y, x, yn)
                    out.append(("#", base, slip, n))
            yield pd.DataFrame(out, columns=["initial", "base", "slip", "n"])

    return both.mapInPandas(verify, "initial string, base string, slip string, n long")


def clusters(rows: list[tuple[str, str, str, bool, str, int]], known_given: frozenset[str]) -> dict[tuple[str, str, bool, str], int]:
    """Author number of every ``(family, given, dotted, mids)`` of one family name and initial.

    Full given names (nicknames and slips put right) with their middle initials are the authors; a
    shorter spelling joins the one author it can mean and stays alone where it can mean several.
    """
    sigs = [(g, d, m, (f, g, d, m)) for _, f, g, d, m, _ in rows]
    full = sorted({NICKNAMES.get(g, g) for g, d, _, _ in sigs if len(g) > 1 and not (d and g not in NICKNAMES)})
    root = {g: g for g in full}
    for g in full:
        if g not in known_given:
            near = [h for h in full if h != g and _near(g, h, 1)]
            sure = [h for h in near if h in known_given]
            pick = sure or [h for h in near if h < g]
            if pick:
                root[g] = pick[0]
    number: dict[tuple, int] = {}
    authors: dict[tuple[str, str], int] = {}
    mids_of: dict[str, set[str]] = defaultdict(set)
    spelled = []
    for g, d, m, key in sigs:
        n = NICKNAMES.get(g, g)
        if n in root and len(g) > 1:
            r = root[n]
            while root.get(r, r) != r:
                r = root[r]
            spelled.append((r, m, key))
            if m:
                mids_of[r].add(m)
    for r, m, key in spelled:
        own = {x for x in mids_of[r] if x.startswith(m)} if m else mids_of[r]
        longest = {x for x in own if not any(y != x and y.startswith(x) for y in own)}
        whole = next(iter(longest)) if len(longest) == 1 else m
        number[key] = authors.setdefault((r, whole), len(authors))
    by_initial: dict[str, set[str]] = defaultdict(set)
    short = [(g, d, m, key) for g, d, m, key in sigs if key not in number]
    for g, _, m, _ in short:
        if m:
            by_initial[g[:1]].add(m)
    fixed = dict(authors)
    for g, d, m, key in short:
        fits = {n for (r, whole), n in fixed.items() if r.startswith(g) and (not m or not whole or whole.startswith(m) or m.startswith(whole))}
        exact = {n for (r, whole), n in fixed.items() if r.startswith(g) and m and whole == m}
        if len(exact) == 1:
            number[key] = exact.pop()
        elif len(fits) == 1 and (m or len({x for x in by_initial[g[:1]] if not any(w.startswith(x) or x.startswith(w) or not w for (r, w) in fixed if r.startswith(g))}) == 0):
            number[key] = fits.pop()
        elif not fits:
            other = by_initial[g[:1]]
            longest = {x for x in other if x.startswith(m) and not any(y != x and y.startswith(x) for y in other)}
            whole = next(iter(longest)) if len(longest) == 1 else m
            number[key] = authors.setdefault((g, whole), len(authors))
        else:
            number[key] = authors.setdefault(("?" + g, m), len(authors))
    return number


def author_names(papers: DataFrame, refs: DataFrame, authors_json: str = "authors_json", authors_text: str = "authors_text") -> DataFrame:
    """``name, n``: the distinct names of both tables without outer blanks, with their rows; malformed lists hold none."""
    listed = papers.select(F.explode(F.from_json(F.col(authors_json), "array<string>")).alias("name"))
    split = refs.select(F.explode(F.split(F.col(authors_text), r"[,;&]|\band\b")).alias("name")).withColumn("name", F.regexp_replace("name", r"\s*\bet al\b\.?\s*$", ""))
    return listed.union(split).select(F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


def link_names(names: DataFrame) -> DataFrame:
    """``name, family, initial, author`` of every name in ``names`` (``name, n``): equal last three columns mean one author.

    Null and blank names, and names without a letter, give no row; repeated names count together. Names
    collapse to distinct signatures (family, given, middle initials) before anything is compared, so a
    family name that a third of all rows carry is a handful of signatures per initial. Family names that
    differ by one slip meet on the rarest q-grams of the shorter list (prefix filter for one changed, added,
    lost or swapped letter: five grams) together with the initial; no list of all names is broadcast.
    Tokens are weighted by their counts over all names; collaborations are linked by ``group_pairs``.
    """
    from lucerna.functions.text import fold
    from lucerna.runtime import cut

    clean = names.where(F.col("name").isNotNull() & (F.trim("name") != "")).groupBy("name").agg(F.sum("n").alias("n"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(n, *parse(n, f)) for n, f in zip(b["name"], b["f"])]
            yield pd.DataFrame(out, columns=["name", "kind", "family", "other", "given", "dotted", "mids"])

    parsed = clean.select("name", fold(F.col("name")).alias("f")).mapInPandas(split, KIND_SCHEMA).where("kind <> 'none' and family <> ''")
    parsed = cut(parsed.join(clean, "name"))
    sure = parsed.where("kind in ('comma', 'initials')")
    votes = sure.select(F.col("family").alias("tok"), F.lit(1).alias("fam"), F.lit(0).alias("giv"), F.lit("").alias("by")).unionByName(
        sure.where("kind = 'comma' and length(given) > 1 and not dotted").select(F.col("given").alias("tok"), F.lit(0).alias("fam"), F.lit(1).alias("giv"), F.col("family").alias("by"))
    ).groupBy("tok").agg(F.sum("fam").alias("fam"), F.sum("giv").alias("giv"), F.approx_count_distinct("by").alias("families"))
    two = parsed.where("kind = 'two'").join(votes.select(F.col("tok").alias("family"), (F.col("fam") - F.col("giv")).alias("s_last")), "family", "left").join(
        votes.select(F.col("tok").alias("other"), (F.col("fam") - F.col("giv")).alias("s_first")), "other", "left").fillna(0, ["s_last", "s_first"])
    swap = (F.col("s_first") > F.col("s_last")) | (F.col("s_first") == F.col("s_last")) & F.col("family").isin(*NICKNAMES)
    two = two.select("name", "kind", F.when(swap, F.col("other")).otherwise(F.col("family")).alias("family"), F.when(swap, F.col("family")).otherwise(F.col("other")).alias("given"), "dotted", "mids", "n")
    people = sure.select("name", "kind", "family", "given", "dotted", "mids", "n").unionByName(two).unionByName(parsed.where("kind in ('group', 'single')").select("name", "kind", "family", "given", "dotted", "mids", "n"))
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv])
    people = cut(people.withColumn("initial", F.when(F.col("kind") == "group", "#").otherwise(F.substring(F.coalesce(nick[F.col("given")], F.col("given")), 1, 1))))

    # family names one slip apart, by the prefix filter on their rarest q-grams
    fams = people.groupBy("family", "initial").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"), F.collect_set(F.when(F.length("mids") > 0, F.substring("mids", 1, 1))).alias("m1"))
    fams = cut(fams)
    people_fams = fams.where("initial <> '#'")
    # a token's weight: how few of the distinct family names with an initial carry it
    tokens = people_fams.select("family", "initial", "spellings", F.explode(F.array_distinct(F.split("family", " "))).alias("t"))
    counted = tokens.groupBy("t").agg(F.sum("spellings").alias("df")).crossJoin(people_fams.agg(F.sum("spellings").alias("total")))
    weighted = tokens.join(counted, "t").groupBy("family", "initial").agg(F.collect_list(F.struct("t", F.log((1 + F.col("total")) / F.col("df")).alias("w"))).alias("ws"))
    long = people_fams.where("length(family) >= 5").join(weighted, ["family", "initial"])
    keyed = long.join(_grams(long, "family"), "family")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, ["gram", "initial"]).where("a.family <> b.family and abs(length(a.family) - length(b.family)) <= 1 and (a.n > b.n or a.n = b.n and a.family < b.family)").where(F.levenshtein(F.col("a.family"), F.col("b.family")) <= 2)
    near = near.select("initial", F.col("a.family").alias("base"), F.col("b.family").alias("slip"), F.col("a.n").alias("n"), F.col("a.m1").alias("m1"), F.col("b.m1").alias("m2"), F.col("a.spellings").alias("s1"), F.col("b.spellings").alias("s2"), F.col("a.ws").alias("w1"), F.col("b.ws").alias("w2")).dropDuplicates(["initial", "base", "slip"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = []
            for i, base, slip, m1, m2, s1, s2, w1, w2 in zip(x["initial"], x["base"], x["slip"], x["m1"], x["m2"], x["s1"], x["s2"], x["w1"], x["w2"]):
                agree = not len(m1) or not len(m2) or bool(set(m1) & set(m2))
                rare = {r["t"]: r["w"] for r in [*w1, *w2]} | {i: 1.0}
                own = s2 >= OWN and s2 * RARER > s1
                keep.append(not own and agree and all(_near(p, q, 1) for p, q in zip(base.split(), slip.split())) and len(base.split()) == len(slip.split()) and soft_similarity([*base.split(), i], [*slip.split(), i], rare) >= SAME)
            yield x[keep][["initial", "base", "slip", "n"]]

    found = near.mapInPandas(verify, "initial string, base string, slip string, n long").unionByName(group_pairs(fams))
    found = cut(found)  # read twice below: the plan stays small on the driver
    best = found.groupBy("initial", "slip").agg(F.max_by("base", F.struct("n", "base")).alias("base"))
    tops = best.select("initial", F.col("slip").alias("base"), F.col("base").alias("top"))
    best = best.join(tops, ["initial", "base"], "left").select("initial", F.col("slip").alias("family"), F.coalesce("top", "base").alias("base"))
    rooted = cut(people.join(best, ["initial", "family"], "left").withColumn("root", F.coalesce("base", "family")).drop("base"))

    common = votes.where("families >= 4 and giv > fam").select(F.col("tok").alias("given"), F.lit(True).alias("common"))
    sigs = rooted.groupBy("root", "initial", "family", "given", "dotted", "mids").agg(F.sum("n").alias("n")).join(common, "given", "left")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for root, initial, group in zip(b["root"], b["initial"], b["g"]):
                rows = [(root, x["family"], x["given"], bool(x["dotted"]), x["mids"], x["n"]) for x in group]
                if initial == "#" or not initial:
                    number = {r[1:5]: 0 for r in rows}
                elif len(rows) == 1:
                    number = {rows[0][1:5]: 0}
                else:
                    number = clusters(rows, frozenset(NICKNAMES.get(x["given"], x["given"]) for x in group if x["common"]))
                out += [(root, initial, *r[1:5], number[r[1:5]]) for r in rows]
            yield pd.DataFrame(out, columns=["root", "initial", "family", "given", "dotted", "mids", "author"])

    # a fixed number of tasks: the rows are few bytes but much work, which AQE would put into one task
    tasks = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), names.sparkSession.sparkContext.defaultParallelism)
    groups = sigs.repartition(tasks, "root", "initial").groupBy("root", "initial").agg(F.collect_list(F.struct("family", "given", "dotted", "mids", "n", "common")).alias("g"))
    solved = groups.mapInPandas(resolve, "root string, initial string, family string, given string, dotted boolean, mids string, author int")
    return rooted.join(solved, ["root", "initial", "family", "given", "dotted", "mids"]).select("name", F.col("root").alias("family"), "initial", "author")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """``name_a, name_b``: every pair of different spellings of one author, ``name_a`` the smaller by code points."""
    a, b = linked.toDF("name_a", "f", "i", "k"), linked.toDF("name_b", "f", "i", "k")
    return a.join(b, ["f", "i", "k"]).where("name_a < name_b").select("name_a", "name_b").distinct()
