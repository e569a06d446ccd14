"""Problem 2: variant spellings of names typed by people.

A name is brought to tokens in a canonical order (titles, roles and articles
dropped, `Last, First` turned round, abbreviations and nicknames resolved) and
becomes a vector of character n-grams weighted by inverse document frequency.
All pairs above a cosine threshold come from a distributed sparse join: a vector
is indexed only under its rarest n-grams, as far as the rest cannot reach the
threshold alone. An exact check of the parts (surname, given names, initials)
turns the cosine into a similarity, and average-linkage clustering merges
mutually nearest clusters in rounds until no average reaches the threshold.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._util import cut

#: Short forms of given names by formal name (fixed values).
NICKNAMES = {
    "alexander": "alex sandy xander sasha", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "barbara": "barb barbie", "benjamin": "ben benny benji", "bernard": "bernie", "catherine": "cathy kate katie", "charles": "charlie chuck chas", "christina": "tina chris",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "donald": "don donnie", "dorothy": "dot dottie dolly", "edward": "ed eddie ted teddy ned", "eleanor": "ellie nell nora", "elizabeth": "liz lizzie beth betty eliza betsy libby", "eugene": "gene", "frances": "fran fanny",
    "francis": "frank", "francisco": "paco pancho", "frederick": "fred freddie freddy", "gabriel": "gabe", "gabriela": "gabi gaby", "josephine": "josie jo", "cosima": "cosi", "rosalba": "rosa", "george": "georgie", "gerald": "gerry jerry", "giuseppe": "beppe peppe", "gregory": "greg", "harold": "harry hal", "helen": "nell", "henrietta": "etta hetty hattie", "henry": "harry hank hal", "isabella": "izzy bella isa belle",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie kat kitty kay", "kenneth": "ken kenny", "lawrence": "larry lars", "leonard": "len lenny leo", "louis": "lou louie",
    "margaret": "maggie peggy meg marge greta daisy", "martin": "marty", "mary": "molly polly", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "penelope": "penny nell", "peter": "pete",
    "philip": "phil", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "samantha": "sam", "sarah": "sally", "stanley": "stan", "stephanie": "steph", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy", "susanna": "sue susie suzy",
    "theodore": "ted teddy theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "valentina": "val tina", "valerie": "val", "veronica": "ronnie", "victor": "vic", "victoria": "vicky tori vic", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally", "william": "bill will billy willy liam", "winifred": "winnie fred freddie freda", "zachary": "zach zack",
}
_FORMAL: dict[str, set[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        _FORMAL.setdefault(_s, set()).add(_formal)
#: Abbreviations in names of organisations (fixed values).
ABBREVIATIONS = {
    "&": "and", "+": "and", "f": "for", "inst": "institute", "univ": "university", "u": "university", "dept": "department", "dep": "department", "lab": "laboratory", "labs": "laboratory", "ctr": "centre", "center": "centre", "cent": "centre", "soc": "society", "assoc": "association", "assn": "association", "coll": "collective", "natl": "national", "intl": "international", "org": "organisation", "organization": "organisation", "fdn": "foundation",
}
#: Names of one n-gram that meet in one place, and that are multiplied at once.
SPLIT, BLOCK = 4096, 512
_ORGANISED = frozenset("institute university department laboratory centre society association collective school college academy museum library press foundation group council committee office organisation bureau guild union studio".split())
_TITLES = frozenset("dr prof professor mr mrs ms miss sir dame rev phd md jr sr ed eds editor trans translator".split())
_PARTICLES = frozenset("de van von der den del della di da dos du la le ter ten zu zur".split())
_WORD = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*|[&+]")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d")


def parse(name: str) -> tuple[bool, str, tuple[str, ...]]:
    """(whether it is an organisation, surname or place, given names or the words), in plain letters.

    Brackets hold a role or, with organisations, a place; `A, B` puts the surname
    or the place last. Particles belong to the surname.
    """
    low = plain(name).replace("_", ".")
    bracket = " ".join(re.findall(r"[(\[]([^)\]]*)[)\]]", low))
    body = re.sub(r"[(\[][^)\]]*[)\]]", " ", low)
    expand = lambda text: [ABBREVIATIONS.get(w, w) for w in _WORD.findall(text.replace(".", " "))]
    words = expand(body)
    if len(words) > 2 and not _ORGANISED.isdisjoint(words) or " and " in f" {' '.join(words)} " and len(words) > 3:
        extra = [w for w in expand(bracket) if w not in _TITLES]
        bag = [w for w in words + extra if w not in ("the", "and", "for", "of")]
        return True, "", tuple(sorted(bag))
    head, comma, tail = body.partition(",")
    split = lambda text: [w for w in _WORD.findall(re.sub(r"\.(?=\S)", ". ", text).replace(".", " ")) if w not in _TITLES]
    if comma and split(tail):
        last, given = split(head), split(tail)
    else:
        all_words = split(body)
        at = len(all_words) - 1
        while at > 1 and all_words[at - 1] in _PARTICLES:
            at -= 1
        given, last = all_words[:at], all_words[at:]
    while given and given[-1] in _PARTICLES:
        last.insert(0, given.pop())
    return False, " ".join(last), tuple(given)


def ngrams(parsed: tuple[bool, str, tuple[str, ...]], size: int = 3) -> Counter[str]:
    """N-grams of the words with their edges, whatever their order; initials and short forms stand by their letters."""
    organisation, last, given = parsed
    out: Counter[str] = Counter()
    for word in (given if organisation else [*last.split(), *(w for w in given if len(w) > 2 and w not in _FORMAL)]):
        edged = f"^{word}$"
        for i in range(max(1, len(edged) - size + 1)):
            out[edged[i : i + size]] += 1
    if not organisation:
        for word in given:
            for form in {word, *_FORMAL.get(word, ())}:
                out["~" + form[0]] = 1
    return out


def _near(a: str, b: str) -> bool:
    """Whether two words differ by one typing error: a letter more, less or other, or two swapped; by two if they are long."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[i - 2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1] <= 1


def _given(a: str, b: str) -> float:
    """How well two given names agree: 1 the same, less for short forms, typing errors and initials, 0 not at all."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        initials = {x[0] for w in (a, b) if len(w) > 1 for x in (w, *_FORMAL.get(w, ()))}
        short = a if len(a) == 1 else b
        return 0.8 if short in initials else 0.0
    fa, fb = {a, *_FORMAL.get(a, ())}, {b, *_FORMAL.get(b, ())}
    if fa & fb:
        return 0.95
    short, long = sorted((a, b), key=len)
    if len(short) <= 5 and short[-1] in "iy" and long.startswith(short[:3]) and len(short) < len(long):  # a pet form in -i, -ie, -y
        return 0.9
    return 0.9 if _near(a, b) else 0.85 if any(_near(x, y) for x in fa for y in fb) else 0.0


def similarity(a: tuple[bool, str, tuple[str, ...]], b: tuple[bool, str, tuple[str, ...]]) -> float:
    """The exact check of two parsed names, 0 to 1.

    Persons: the surname may have one typing error, the first given names must
    agree, and further ones where both have them. Parts in another order are
    tried. Organisations: all words but one typing error pair up.
    """
    if a[0] != b[0]:
        return 0.0
    if a[0]:
        x, y = list((Counter(a[2]) - Counter(b[2])).elements()), list((Counter(b[2]) - Counter(a[2])).elements())
        if len(x) > 2 or len(x) != len(y):
            return 0.0
        left = list(y)
        for w in x:
            hit = next((v for v in left if _near(w, v)), None)
            if hit is None:
                return 0.0
            left.remove(hit)
        return 1.0 - 0.05 * len(x)
    best = _person(a, b)
    for u, v in ((a, b), (b, a)):  # the parts may have been reordered without a comma
        if u[2] and len(u[1].split()) == 1 and len(u[2]) >= 1:
            best = max(best, 0.95 * _person((False, u[2][0], (*u[2][1:], u[1])), v))
            best = max(best, 0.95 * _person((False, u[2][-1], (u[1], *u[2][:-1])), v))
            best = max(best, 0.95 * _person((False, " ".join(u[2]), (u[1],)), v))
    return best


def _person(a: tuple[bool, str, tuple[str, ...]], b: tuple[bool, str, tuple[str, ...]]) -> float:
    if not a[2] or not b[2]:
        return 0.0
    same = a[1] == b[1]
    if not same and not _near(a[1], b[1]):
        return 0.0
    score = _given(a[2][0], b[2][0])
    if not score or not same and score in (0.9, 0.85):  # one typing error in all
        return 0.0
    for x, y in zip(a[2][1:], b[2][1:], strict=False):
        more = _given(x, y)
        if not more:
            return 0.0
        score = min(score, more)
    return score * (1.0 if same else 0.95)


def vectors(names: DataFrame, size: int) -> DataFrame:
    """`name, gram, tf` of the column `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, gram, float(n)) for name in batch.column(0).to_pylist() for gram, n in ngrams(parse(name), size).items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["name", "gram", "tf"])

    return names.select("name").mapInArrow(run, "name string, gram string, tf double")


def cosine_pairs(names: DataFrame, threshold: float = 0.2, size: int = 3) -> DataFrame:
    """`a, b, cosine` (a < b) of all pairs of distinct names at or above the threshold.

    An n-gram weighs its count times the square of its inverse document
    frequency, so what many names share, as given names are, hardly counts.
    Top-n is unbounded here: every partner above the threshold is kept, because
    a cap would lose spellings. N-grams are ordered from rare to common for all
    names alike; a name is joined only on the first of them, up to where the
    norm of the rest falls below the threshold, so two names that reach it meet
    on an n-gram that both hold in their first part. Frequent n-grams are joined
    only by names that have little else.

    A name goes to each of its first n-grams with its whole vector, and the names
    of one n-gram are multiplied there in blocks; a pair counts at the first
    n-gram on which it meets. So what is written grows with the names and not
    with the pairs that meet. An n-gram of more than `SPLIT` names is split into
    groups, every two of which meet in a place of their own.
    """
    v, block = vectors(names, size), BLOCK
    total = names.count()
    df = v.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(total + 1)) / F.col("df"))
    w = v.join(df, "gram").select("name", F.struct("df", F.xxhash64("gram").alias("gram"), (F.col("tf") * idf * idf).alias("w")).alias("part"))
    whole = w.groupBy("name").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = cut(whole.select("name", F.col("parts.gram").alias("grams"), F.col("parts.w").alias("ws")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                units, counts = [], []
                for x in batch.column(2).to_pylist():
                    unit = np.array(x) / max(np.sqrt(np.dot(x, x)), 1e-6)
                    units.append(unit)
                    counts.append(int((np.sqrt(np.cumsum((unit * unit)[::-1])[::-1]) >= threshold * (1 - 1e-9)).sum()))
                row = pa.array(np.repeat(np.arange(len(batch)), counts))
                places = np.concatenate([np.arange(n) for n in counts])
                heads = np.repeat(batch.column(1).offsets.to_numpy()[:-1] - batch.column(1).offsets[0].as_py(), counts)
                key = batch.column(1).flatten().take(pa.array(heads + places))
                yield pa.RecordBatch.from_arrays([key, batch.column(0).take(row), pa.array(places, pa.int32()), batch.column(1).take(row), pa.array(units, pa.list_(pa.float64())).take(row)], names=["gram", "name", "place", "grams", "ws"])

    posted = whole.mapInArrow(first, "gram long, name string, place int, grams array<long>, ws array<double>")
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("gram", F.ceil(F.col("n") / SPLIT).alias("groups"))
    own = F.when(F.col("groups").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("name"), F.col("groups"))).cast("int")
    spread = posted.join(F.broadcast(often), "gram", "left").withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("groups") - 1, F.lit(0)).cast("int"))))
    spread = spread.select("gram", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("right"), "name", "place", "grams", "ws")
    met = spread.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high", "right")

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def multiplied(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            heads, flat, weights = batch.column(6).offsets.to_numpy() - batch.column(6).offsets[0].as_py(), batch.column(6).flatten().to_numpy(), batch.column(7).flatten().to_numpy()
            place = batch.column(5).to_numpy()
            two, right = batch.column(1).to_numpy() != batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            left_rows, right_rows, cosines = [], [], []

            def matrices(at: int, to: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                many = np.diff(heads[at : to + 1])
                row = np.repeat(np.arange(to - at), many)
                step = np.arange(len(row)) - np.repeat(heads[at:to] - heads[at], many)
                where = np.searchsorted(columns, flat[heads[at] : heads[to]])
                where[where == len(columns)] = 0
                there = columns[where] == flat[heads[at] : heads[to]]
                row, where, before = row[there], where[there], (step < np.repeat(place[at:to], many))[there]
                unit, earlier = np.zeros((to - at, len(columns))), np.zeros((to - at, len(columns)), np.float32)
                unit[row, where] = weights[heads[at] : heads[to]][there]
                earlier[row[before], where[before]] = 1
                return unit, earlier

            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                if end - start < 2:
                    continue
                middle = start + int(np.searchsorted(right[start:end], True)) if two[start] else end
                for a in range(start, middle, block):
                    a_end = min(a + block, middle)
                    for b in range(middle if two[start] else a, end, block):
                        b_end = min(b + block, end)
                        if a == b and a_end - a < 2:
                            continue
                        if a == b:
                            columns, n = np.unique(flat[heads[a] : heads[a_end]], return_counts=True)
                            ua, ea = ub, eb = matrices(a, a_end, columns[n > 1])
                        else:
                            columns = np.intersect1d(flat[heads[a] : heads[a_end]], flat[heads[b] : heads[b_end]])
                            (ua, ea), (ub, eb) = matrices(a, a_end, columns), matrices(b, b_end, columns)
                        cosine = ua @ ub.T
                        fit = (cosine >= threshold) & (ea @ eb.T == 0)
                        i, j = np.nonzero(np.triu(fit, 1) if a == b else fit)
                        left_rows.append(a + i)
                        right_rows.append(b + j)
                        cosines.append(cosine[i, j])
            if not left_rows:
                return pa.RecordBatch.from_pydict({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
            x, y = (batch.column(4).take(pa.array(np.concatenate(rows))).to_pylist() for rows in (left_rows, right_rows))
            return pa.RecordBatch.from_arrays([pa.array(list(map(min, x, y)), pa.string()), pa.array(list(map(max, x, y)), pa.string()), pa.array(np.concatenate(cosines))], names=["a", "b", "cosine"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
            held = []
            if not len(whole):
                continue
            gram, low, high = (whole.column(i).to_numpy() for i in range(3))
            starts = np.nonzero(np.append(True, (gram[1:] != gram[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[0]
            if len(starts) > 1:
                yield multiplied(whole, starts[:-1], starts[1:])
            held = [whole.slice(int(starts[-1]))]
        if held:
            yield multiplied(held[0], np.array([0]), np.array([len(held[0])]))

    return met.mapInArrow(dot, "a string, b string, cosine double")


def checked(pairs: DataFrame) -> DataFrame:
    """`a, b, sim` of the pairs that pass the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def parsed(name: str):
            if len(known) > 200_000:
                known.clear()
            return known.get(name) or known.setdefault(name, parse(name))

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sims = pa.array([similarity(parsed(x), parsed(y)) for x, y in zip(a, b, strict=True)], pa.float64())
            keep = pa.array([s > 0 for s in sims.to_pylist()])
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), sims)], names=["a", "b", "sim"])

    return pairs.select("a", "b").mapInArrow(run, "a string, b string, sim double")


def average_linkage(names: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`name, cluster`: average-linkage clusters of names from similarities `a, b, sim` (absent pairs are 0), `cluster` the least name.

    Every round merges the clusters that are each other's nearest, ties going to
    the lesser name, if their average similarity reaches the threshold. Average
    linkage never favours a merged cluster over both its parts, so merging all
    such pairs of a round at once gives the hierarchy that merging one by one
    does. Sums of similarities and sizes carry over; nothing is collected.
    """
    size = cut(names.select("name", F.col("name").alias("cluster")))
    links = cut(pairs.select("a", "b", F.col("sim").cast("double").alias("total")))
    while True:
        counts = size.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "total"))
        average = both.join(counts.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        average = average.withColumn("average", F.round(F.col("total") / (F.col("na") * F.col("nb")), 9)).where(F.col("average") >= threshold)
        key = F.struct(-F.col("average"), F.least("a", "b"), F.greatest("a", "b"))
        best = average.groupBy("a").agg(F.min_by("b", key).alias("b"))
        mutual = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")
        merge = cut(mutual.select(F.col("b").alias("old"), F.col("a").alias("new")))
        if merge.isEmpty():
            return size
        size = cut(size.join(merge, F.col("cluster") == F.col("old"), "left").select("name", F.coalesce("new", "cluster").alias("cluster")))
        moved = links.join(merge.select(F.col("old").alias("a"), F.col("new").alias("na")), "a", "left").join(merge.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b", "left")
        moved = moved.select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "total").where("a <> b")
        links = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")))


def clusters(books: DataFrame, threshold: float = 0.2, linkage: float = 0.45) -> DataFrame:
    """`name, cluster` of every distinct spelling in `author` (array of strings). Null and blank entries are none."""
    names = cut(books.select(F.explode("author").alias("name")).where(F.trim("name") != "").distinct())
    return average_linkage(names, checked(cosine_pairs(names, threshold)), linkage)


def same_entity(books: DataFrame) -> DataFrame:
    """`name_a, name_b` of all pairs of different spellings in one cluster, in code point order."""
    c = clusters(books)
    pairs = c.select(F.col("name").alias("name_a"), "cluster").join(c.select(F.col("name").alias("name_b"), "cluster"), "cluster")
    return pairs.where("name_a < name_b").select("name_a", "name_b")

