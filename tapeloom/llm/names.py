"""Problem 3: the spellings of one act's name.

Method: trie join. Every name is read into its parts (given name, surname; or an act's own two words and
the rest) whatever their order, and gives the forms it may be written in: its parts run together, with the
given name's short forms brought to one, with initial, surname alone, with or without the rest. All forms
are sharded into tries by stretches of their letters (of forms d errors apart, one of d + 1 stretches is the
same), each trie is walked by a Levenshtein automaton (errors and swaps of neighbours, within a distance that is
a parameter), and pairs of forms found that way are checked on the parts, in every order of the words, before
they count.

Names that say enough by themselves (a given name and a surname, or an act's own two words) are linked to
classes first. Names that do not (initials, surnames alone, words run together) join the class that they fit
if there is just one: two acts may share a surname, and such a name must not tie them together.

Work is on distinct names. A shard holds names that have a stretch of letters in common at one place; one that
outgrows a task is split into blocks, and each pair of blocks is a task. The classes are found by passing on the
least name along the links, in rounds written to the shared folder. The result is a class per name;
:func:`pairs` expands it. Null and empty names are none. Accents and disguised letters are folded before a
name is read; names in other scripts are read by their own letters, and have those for a key.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm.canonical import near, plain, short_for
from tapeloom.tables import cut, table

# Given names and their usual short forms.
GIVEN = """
abigail abby abbie gail; albert al bert bertie; alexander alex alec sandy sasha; alfred alf fred; alice ally; amanda mandy; andrew andy drew; angela angie; ann anne annie nan; anthony tony;
arthur art; barbara barb barbie babs; benjamin ben benny benji; beatrice bea trixie; bernard bernie; bradley brad; caroline carrie caro; catherine cathy cath; charles charlie chuck chas; charlotte lottie;
christine chris tina; christopher chris kit topher; clifford cliff; cynthia cindy; daniel dan danny; david dave davey; deborah deb debbie; dennis denny; donald don donnie; dorothy dot dottie dolly;
edmund ed ned; edward ed eddie ned ted; eleanor ellie nell nora; elizabeth liz beth betty lizzie eliza bess libby; emily em emmy; ernest ernie; eugene gene; florence flo; frances fran frannie; francis frank;
franklin frank; frederick fred freddie; gabriel gabe; george georgie; gerald gerry jerry; gertrude gert trudy; gilbert gil; gregory greg; harold harry hal; harriet hattie; helen nell; henry hank harry hal;
herbert herb bert; howard howie; isabel izzy bella; jacob jake; james jim jimmy jamie; janet jan; jeffrey jeff; jennifer jen jenny; jessica jess; joan joanie; john jack johnny; jonathan jon; joseph joe joey;
josephine jo josie; joshua josh; judith judy; katherine kate kathy katie kit kitty; kenneth ken kenny; lawrence larry; leonard len lenny leo; leslie les; lillian lily; louis lou; louise lou; lucille lucy;
margaret maggie meg peg peggy marge; martha marty; martin marty; mary molly polly; matthew matt; maxwell max; michael mike mick mickey; mildred millie; nancy nan; nathaniel nat nate nathan; nicholas nick;
norman norm; oliver ollie; pamela pam; patricia pat patsy patty trish; patrick pat paddy; peter pete; philip phil; rachel rae; raymond ray; rebecca becky becca; richard rick dick rich richie; robert bob bobby rob;
roger rog; ronald ron ronnie; rosemary rosie; russell russ; ruth ruthie; samantha sam; samuel sam sammy; sandra sandy; sarah sally sadie; sidney sid; stanley stan; stephen steve; steven steve; susan sue susie;
susannah sue susie sukey; sylvia syl; teresa terry tess; theodore ted teddy theo; thomas tom tommy; timothy tim; valerie val; veronica ronnie; victor vic; victoria vicky tori; vincent vince; virginia ginny;
walter walt wally; warren; wendy; wesley wes; wilfred wilf; william bill billy will; winifred winnie; zachary zach
"""
# Words for kinds of ensembles.
ENSEMBLES = "band orchestra trio quartet quintet sextet ensemble collective company revue ramblers brothers sisters group project experience choir singers players boys allstars combo duo string jug jazz".split()
_JOINTS = {"and", "with", "w", "feat", "featuring", "n"}
_HEAD = re.compile(r"^(.*?)(?<!\d)(?:\d{4}-\d\d-\d\d|\d{4}\.\d\d\.\d\d|\d\d-\d\d-\d\d)(?!\d)", re.S)
#: Errors between two forms of one name at most, and the letters that a form has for each.
DISTANCE, LETTERS_PER_ERROR = 1, 6
#: Rows of forms that one task joins, about; shards are hashed to as many buckets as that needs, and split beyond it.
BUCKET_ROWS = 20_000
#: Rounds of passing on the least name; a class of names is far less wide.
ROUNDS = 20


@lru_cache(maxsize=1)
def _given() -> dict[str, frozenset[str]]:
    """Every given name and short form, with the full names it may stand for."""
    out: dict[str, set[str]] = defaultdict(set)
    for line in GIVEN.split(";"):
        full, *short = line.split()
        for w in (full, *short):
            out[w].add(full)
    return {w: frozenset(s) for w, s in out.items()}


@lru_cache(maxsize=1 << 14)
def given_names(word: str) -> frozenset[str]:
    """The full given names that a word may be: itself, a short form, an abbreviation, or with one error."""
    known = _given()
    if word in known:
        return known[word]
    full = {f for s in known.values() for f in s}
    if len(word) < 3:
        return frozenset(f for f in full if len(word) == 2 and f[0] == word[0] and f[-1] == word[1])
    starts = {f for f in full if len(f) > len(word) and f.startswith(word)}
    if starts:
        return frozenset(starts)
    typos = {f for w, s in known.items() if len(w) >= 4 and len(word) >= 4 and near(word, w) for f in s}
    if typos:
        return frozenset(typos)
    return frozenset(f for f in full if len(word) <= 5 and len(f) - len(word) >= 2 and f[-1] == word[-1] and short_for(word, f)) or frozenset(
        f for f in full if len(word) <= 5 and len(f) - len(word) >= 2 and short_for(word, f) and not re.search("[aeiou]", word[1:])
    )


def key_of(name: str) -> str:
    """The name's key: its words of a-z and 0-9; of a name without any, its words as they are."""
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip() or re.sub(r"[\W_]+", " ", name.lower()).strip()


def words_of(name: str) -> tuple[list[str], list[str]]:
    """(words before a joint, words after it), in the order they are meant."""
    s = plain(name).replace("_", " ")
    if not re.search(r"\s", s.strip()) and s.count(".") > 1 or re.fullmatch(r"\w+(\.\w+)+\.?", s.strip()):
        s = s.replace(".", " ")
    if not re.search(r"\s", s.strip()):
        s = re.sub(r"(?<=[a-z'])(?=[A-Z&+])|(?<=[&+])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", s)
    if "," in s:
        a, b = s.rsplit(",", 1)
        s = f"{b} {a}" if b.strip() else a
    s = re.sub(r"\bw/", " & ", s, flags=re.I).replace("'", "").replace("’", "")
    parts = re.findall(r"[^\W_]+|[&+]", s.lower())
    while parts and parts[0] in ("the", "&", "+"):
        parts.pop(0)
    for i, w in enumerate(parts):
        if 0 < i and (w in "&+" or w in _JOINTS or w == "the") and i + 1 < len(parts):
            return [x for x in parts[:i] if x not in "&+"], [x for x in parts[i:] if x not in "&+" and x != "the" and x not in _JOINTS]
    return [w for w in parts if w != "the" and w not in "&+"], []


def _ensemble(w: str) -> bool:
    return w in ENSEMBLES or len(w) >= 3 and any(near(w, e) for e in ENSEMBLES if len(e) >= 5)


def _all_matched(a: list[str], b: list[str], like) -> bool:
    """Whether every word of ``a`` has a word of ``b`` for its own, in whatever order (a matching by augmenting paths)."""
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j in range(len(b)):
            if j not in tried and like(a[i], b[j]):
                tried.add(j)
                if j not in taken or place(taken[j], tried):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(a)))


class Parts:
    """What a name is read as: given (full names it may be), initial, own (surname, or the act's words run together), rest."""

    def __init__(self, name: str):
        head, tail = words_of(name)
        self.weak, self.given, self.initial, self.rest = False, frozenset(), "", tail
        for k in (2, 1):
            if not tail and len(head) > k + 1 and all(map(_ensemble, head[:k])):
                head = head[k:] + head[:k]
                break
        first = given_names(head[0]) if len(head) > 1 else frozenset()
        last = given_names(head[-1]) if len(head) > 1 and not tail and not first and head[-1] in _given() else frozenset()
        if last:
            head, first = [head[-1], *head[:-1]], last
        self.swapped = "".join(head[1::-1]) if len(head) > 1 and (tail or len(head) > 2) else ""
        if len(head) > 1 and _ensemble(head[1]) and not first:
            self.own, self.rest, self.swapped = head[0], head[1:] + tail, ""
        elif tail or not head:
            self.own = "".join(head[:2]) if head else ""
            self.rest = head[2:] + tail
        elif len(head) == 1:
            self.own, self.weak = head[0], True
        elif len(head[0]) == 1:
            self.initial, self.own, self.weak = head[0], "".join(w for w in head[1:] if len(w) > 1), True
            if not self.own:
                self.initial, self.own = "", "".join(head)
        elif first and not _ensemble(head[-1]):
            self.given, self.own = first, "".join(w for w in head[1:] if len(w) > 1)
        else:
            self.own, self.rest = "".join(head[:2]), head[2:]
        if not self.weak and not self.given and not self.rest and len(head) == 2:
            self.initial = head[0][0]  # may be a person with an unknown given name
            self.last = head[1]
        else:
            self.last = self.own if self.given or self.weak else ""

    def forms(self) -> list[tuple[str, str]]:
        """(form, sort): "f" says enough by itself, "a" is an alias that only a weak name may be linked by, "w" a weak name's own."""
        if not self.own:
            return []
        if self.weak:
            out = [(self.initial + self.own, "w")]
            if not self.initial:
                for g, full in _given().items():
                    if len(g) >= 3 and self.own.startswith(g) and len(self.own) - len(g) >= 6:
                        out += [(f + self.own[len(g) :], "w") for f in full]
            return out
        if len(self.given) > 1:
            # "Ted" is Edward or Theodore: it joins the one that there is, and must not tie both together.
            return [(g + self.own, "w") for g in sorted(self.given)]
        if self.given:
            out = [(g + self.own, "f") for g in self.given]
            return out + [(f, "a") for g in self.given for f in {g[0] + self.own, self.own, self.own + g, self.own + g[0]}]
        out = [(self.own, "f")] + [(f, "f") for f in [self.swapped] if f]
        if self.rest:
            out += [(self.own + "".join(self.rest), "a"), (self.own + self.rest[-1], "a"), (self.own + "the" + "".join(self.rest), "a"), (self.own + "and" + "".join(self.rest), "a"), (self.own + "andthe" + "".join(self.rest), "a")]
        elif self.initial:
            out += [(self.initial + self.last, "a"), (self.last, "a")]
        return out

    def agrees(self, other: Parts) -> bool:
        """Whether two names that say enough may be one act's: no part contradicts, in any order of the rest's words."""
        if bool(self.given) != bool(other.given) and (self.rest or other.rest):
            return False
        if self.given and other.given and not self.given & other.given:
            return False
        if self.rest and other.rest:
            a, b = sorted((self.rest, other.rest), key=len)
            return _all_matched(a, b, lambda x, y: x == y or near(x, y) and min(len(x), len(y)) >= 3 or short_for(x, y) or short_for(y, x))
        return True


class Trie:
    """Strings with a value each, walked by a Levenshtein automaton."""

    def __init__(self):
        self.root: dict = {}

    def add(self, s: str, value: int) -> None:
        node = self.root
        for c in s:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def within(self, s: str, most: int) -> list[tuple[int, int]]:
        """(value, distance) of all strings at most that many errors or swaps of neighbours from s.

        The automaton's states are (place in s, errors, letter owed by a swap).
        """
        out: dict[int, int] = {}
        n = len(s)

        def closed(states: set) -> set:
            # A letter of s may be left out, again and again.
            return states | {(k, e + k - i, "") for i, e, owed in states if not owed for k in range(i + 1, min(n, i + most - e) + 1)}

        stack = [(self.root, closed({(0, 0, "")}))]
        while stack:
            node, states = stack.pop()
            ends = [e for i, e, owed in states if i == n and not owed]
            if ends and "" in node:
                for v in node[""]:
                    out[v] = min(out.get(v, most), min(ends))
            for c, child in node.items():
                if not c:
                    continue
                after = set()
                for i, e, owed in states:
                    if owed:
                        if c == owed:
                            after.add((i, e, ""))
                        continue
                    if i < n and s[i] == c:
                        after.add((i + 1, e, ""))
                    if e < most:
                        after.add((i, e + 1, ""))
                        if i < n:
                            after.add((i + 1, e + 1, ""))
                        if i + 1 < n and s[i + 1] == c:
                            after.add((i + 2, e + 1, s[i]))
                if after:
                    stack.append((child, closed(after)))
        return list(out.items())


def errors(length: int, distance: int = DISTANCE) -> int:
    """How many errors two forms may have between them, by the shorter one's length: short names that differ are different."""
    return min(distance, length // LETTERS_PER_ERROR)


def shard_keys(form: str, distance: int = DISTANCE) -> list[str]:
    """Shards that a form goes to: two forms within their distance meet in at least one.

    The shorter form, of m letters, is cut into one stretch more than it may have errors, with a letter between them,
    so that a swap of neighbours touches one only. If up to the k-th stretch there are as few as k errors, the k-th
    has none, and the other form has it within k places of its own, and within what errors are left of its end.
    """
    n, out = len(form), []
    for m in range(n, max(0, n - distance) - 1, -1):
        d = errors(m, distance)
        if n - m > d or not m:
            continue
        size = (m - d) // (d + 1)
        for k in range(d + 1):
            start = k * (size + 1)
            end = start + size if k < d else m
            out += [f"{k}/{form[start + s : end + s]}" for s in range(-k, k + 1) if abs(n - m - s) <= d - k and start + s >= 0 and end + s <= n]
    return list(dict.fromkeys(out))


def _read(pdf: pd.DataFrame, distance: int) -> pd.DataFrame:
    rows = []
    for name in pdf["name"]:
        key = key_of(name)
        for form, sort in dict.fromkeys(Parts(name).forms()):
            rows += [(key, name, form, sort, s) for s in shard_keys(form, distance)]
    return pd.DataFrame(rows, columns=["key", "name", "form", "sort", "shard"])


def _join(bucket: pd.DataFrame, distance: int) -> pd.DataFrame:
    """Pairs of names whose forms are near, and whose parts agree, shard by shard."""
    shards: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    for key, name, form, sort, shard in bucket[["key", "name", "form", "sort", "shard"]].itertuples(index=False, name=None):
        shards[shard][form].add((key, name, sort))
    parts = lru_cache(maxsize=1 << 16)(Parts)
    out = set()
    for forms in shards.values():
        if sum(map(len, forms.values())) < 2:
            continue
        trie, listed = Trie(), list(forms)
        for i, f in enumerate(listed):
            trie.add(f, i)
        for f in listed:
            mine = [x for x in forms[f] if x[2] != "a"]
            for i, apart in trie.within(f, errors(len(f), distance)) if mine else ():
                g = listed[i]
                if apart > errors(min(len(f), len(g)), distance):
                    continue
                for key, name, sort in mine:
                    for other, other_name, other_sort in forms[g]:
                        if key == other:
                            continue
                        if sort == other_sort == "f":
                            if key < other and parts(name).agrees(parts(other_name)):
                                out.add((key, other, "f", apart))
                        elif sort == "w" and other_sort in "fa":
                            # The first letter may be an initial: there no error is allowed.
                            if f[0] == g[0] and (not apart or f[1:2] == g[1:2]):
                                out.add((key, other, "w", apart))
                        elif sort == other_sort == "w" and key < other and not apart:
                            out.add((key, other, "v", apart))
    return pd.DataFrame(sorted(out), columns=["a", "b", "sort", "distance"])


def classes_of(links: DataFrame) -> DataFrame:
    """(key, class): the least key reachable over the links (a, b). Rounds are written out; none is collected."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("class")).withColumnRenamed("a", "key")
    label = cut(label)
    for _ in range(ROUNDS):
        heard = edges.join(label, edges["b"] == label["key"]).groupBy("a").agg(F.min("class").alias("heard"))
        joined = label.join(heard, label["key"] == heard["a"], "left").select("key", F.least("class", F.coalesce("heard", "class")).alias("near"), F.col("class").alias("was"))
        # Also jump to the class of the class: the width halves each round.
        of = label.select(F.col("key").alias("near"), F.col("class").alias("further"))
        step = cut(joined.join(of, "near", "left").select("key", F.least("near", F.coalesce("further", "near")).alias("class"), "was"))
        done = step.filter(F.col("class") != F.col("was")).isEmpty()
        label = step.select("key", "class")
        if done:
            return label
    raise RuntimeError(f"classes wider than 2^{ROUNDS} links")


def linked(names: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key, class) of every name key that is linked to another, and the links (a, b) found. ``names`` has one column, name."""
    # Few bytes but much work for each name: as many tasks as there are cores, where coalescing by size would make one.
    tasks = 2 * names.sparkSession.sparkContext.defaultParallelism
    read = names.filter("name is not null").select("name").distinct().repartition(tasks)
    placed = read.mapInPandas(lambda it: (_read(pdf, distance) for pdf in it), "key string, name string, form string, sort string, shard string").filter("key <> ''")
    placed = cut(placed)
    buckets = max(1, -(-placed.count() // bucket_rows))
    # A shard of one name joins nothing; one beyond a task's rows is split into blocks, and each pair of blocks is a bucket.
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b")
    sizes = sizes.select("shard", F.ceil(F.col("n") / bucket_rows).alias("blocks"))
    sent = placed.join(sizes, "shard")
    whole = sent.filter("blocks = 1").drop("blocks").withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("string"))
    cells = sent.filter("blocks > 1").withColumn("i", F.pmod(F.xxhash64("form"), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    split = cells.withColumn("bucket", F.concat_ws(" ", "shard", F.least("i", "j"), F.greatest("i", "j"))).drop("blocks", "i", "j")
    bucketed = whole.unionByName(split).repartition(max(tasks, buckets), "bucket")
    found = cut(bucketed.groupBy("bucket").applyInPandas(lambda pdf: _join(pdf, distance), "a string, b string, sort string, distance int").distinct())
    strong = classes_of(found.filter("sort = 'f'"))
    # A key that says enough in one of its spellings is not weak in another.
    sure = placed.filter("sort = 'f'").select(F.col("key").alias("k")).distinct()
    weak = found.filter("sort = 'w'").join(sure, F.col("a") == F.col("k"), "left_anti")
    to = weak.join(strong.select(F.col("key").alias("b"), "class"), "b", "left").select("a", F.coalesce("class", "b").alias("class"), "distance")
    best = to.groupBy("a").agg(F.min("distance").alias("distance"))
    fits = to.join(best, ["a", "distance"]).groupBy("a").agg(F.min("class").alias("class"), F.max("class").alias("other")).filter("class = other").select(F.col("a").alias("key"), "class")
    joined = cut(strong.unionByName(fits))
    # A name on its own that only weak names point to is in its class too.
    alone = joined.select(F.col("class").alias("key")).distinct().join(joined.select("key"), "key", "left_anti").withColumn("class", F.col("key"))
    known = cut(joined.unionByName(alone))
    # Weak names that fit no class still go together where they are the same.
    rest = found.filter("sort = 'v'").join(known.select(F.col("key").alias("a")), "a", "left_anti").join(known.select(F.col("key").alias("b")), "b", "left_anti")
    return known.unionByName(classes_of(rest)), found.select("a", "b")


def link_names(names: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, class) of every name key that is linked to another. ``names`` has one column, name."""
    return linked(names, distance, bucket_rows)[0]


def with_links(classes: DataFrame, links: DataFrame) -> DataFrame:
    """key, class, n_links: how many names of its class a name was found near to itself."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    of = lambda end: classes.select(F.col("key").alias(end), F.col("class").alias(f"class_{end}"))
    counts = ends.join(of("a"), "a").join(of("b"), "b").filter("class_a = class_b").groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n_links"))
    return classes.join(counts, "key", "left").fillna(0, ["n_links"])


def pairs(classes: DataFrame) -> DataFrame:
    """All pairs of one class: name_a < name_b."""
    return classes.select(F.col("key").alias("name_a"), "class").join(classes.select(F.col("key").alias("name_b"), "class"), "class").filter("name_a < name_b").select("name_a", "name_b")


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of problem 3; folder heads without letters or of at most five are none."""
    heads = table(spark, sf_dir, "shows").select(F.regexp_extract("folder_name", _HEAD.pattern, 1).alias("name"))
    heads = heads.filter(F.length(F.regexp_replace("name", "[^A-Za-z]", "")) > 5)
    return table(spark, sf_dir, "artists").select("name").unionByName(table(spark, sf_dir, "releases").select(F.col("data.artist").alias("name"))).unionByName(heads).filter("name is not null").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of name keys of one act; a name without a-z and 0-9 has no key here."""
    classes = link_names(all_names(spark, sf_dir))
    return pairs(classes.filter(F.col("key").rlike("^[a-z0-9 ]+$")))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked name key with its class and its number of links."""
    return with_links(*linked(all_names(spark, sf_dir)))


QUERIES = {q.__name__: q for q in (p3_found, p3_classes)}
