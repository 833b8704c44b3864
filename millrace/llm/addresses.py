"""Problem 5: which address records denote the same place.

Every record is read into components: street name and kind, house number with letter, unit, postcode, and the texts that may
be its city (the city, the state where the two were swapped, the rest of the street line). The locality is the city its
texts spell or nearly spell, else the one its postcode mostly stands with; both come from the data themselves.

Distinct readings are indexed by block and by the deletion neighbourhoods of the street's name and of each of its tokens (a word
and every form of it with one character left out), so that words an edit or a transposition apart meet without any comparison
of whole blocks. A block is a locality with house number, letter and unit, which are hard vetoes. The locality is the one that
city and postcode agree on; a reading whose texts and postcode point to several neighbouring localities (a city misspelled
towards another, a postcode of another town) is put into the block of each.

Then components are assigned. Readings that share a form of the whole name and the kind of street are linked to the least of
them. Names of as many tokens are compared by an assignment of their tokens at least cost, and linked if each token has a partner
an edit away. Such names share forms of two tokens at once, whichever two: each name is looked up by its two rarest tokens among
all pairs of tokens of the others, so none is missed and a frequent word alone brings nothing together. An open reading (no kind
of street, or in its first locality neither itself nor with a partner that points there alone) is assigned to the one candidate
locality and kind of street that costs least: order of the evidence, edits of the name or its tokens, kind missing, records there.
The links are closed to groups, and the records of a group are the pairs.

Defined results: a record without id, street name or house number denotes no known place; nulls, blanks and stand-ins ("-",
"n/a") are missing values; repeated deliveries of one id count once, with every way they are written; words under four
characters have no forms but themselves (an edit makes another word of them); empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.common import Cut

#: Ways to write the kind of a street, by kind.
KINDS = {
    "street": "street st str strasse straat",
    "road": "road rd",
    "lane": "lane ln",
    "drive": "drive dr",
    "boulevard": "boulevard boul blvd bd bld bulevar",
    "avenue": "avenue avenida av ave avda avd",
    "place": "place plaza platz pl pza plz piazza",
    "rue": "rue r",
    "calle": "calle c cl cll",
    "weg": "weg way",
    "square": "square sq",
    "court": "court ct",
    "terrace": "terrace",
    "via": "via",
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws.split()}
_KIND |= {w + de: _KIND[w] for w in ("avenue", "av", "ave", "place", "pl", "rue", "r") for de in ("de", "du", "des")}
#: Kinds that are written as the end of the name, longest first, and as its beginning.
_ENDS = [("strasse", "street"), ("boulevard", "boulevard"), ("avenue", "avenue"), ("street", "street"), ("platz", "place"), ("road", "road"), ("lane", "lane"), ("drive", "drive"), ("blvd", "boulevard"), ("str", "street"), ("weg", "weg"), ("pl", "place"), ("rd", "road")]
_STARTS = [("avenuede", "avenue"), ("avenida", "avenue"), ("placede", "place"), ("avenue", "avenue"), ("plaza", "place"), ("calle", "calle"), ("ruede", "rue"), ("avda", "avenue"), ("avde", "avenue"), ("plde", "place")]
_SMALL = {"de", "la", "le", "du", "des", "del", "der", "den", "das", "las", "los", "el", "the", "of", "d", "l", "no", "nr", "num", "numero", "n"}
_MISSING = {"", "-", "--", "n/a", "na", "none", "null", "unknown", "unk", "?", "x", "xx", "tbd", "."}

_UK = re.compile(r"(?<![A-Za-z])([A-Za-z]{1,2}\d{1,2}) ?(\d[A-Za-z]{2})(?![A-Za-z])")
_ZIP = re.compile(r"(?<!\d)(\d{5}|\d{3} \d{2})(?:-\d{4})?(?!\d)")
_UNIT = re.compile(r"(?:\b(?:apartment|apt|flat|unit|suite|ste|appartement|wohnung|whg|piso|room|rm)\b\.?|#)\s*(?:no\b\.?|nr\b\.?|#)?\s*(\d+)(?:(?:-| (?=[a-z]\s*(?:$|[,;])))?([a-z])(?![a-z]))?")
_NUMBER = re.compile(r"(?<![\w])(\d+)(?:(?:-?([a-z])(?![a-z.'/])|\s+([a-d])(?=\s|$|[,;])))?")


def fold(text: str | None) -> str:
    """Lower case without accents. An umlaut written with an e is one character longer, which the index allows for."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    text = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ẞ", "SS").replace("ø", "o")) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def plain(text: str | None) -> str:
    """A folded name without anything but letters; missing stand-ins are empty."""
    text = fold(text)
    if text in _MISSING:
        return ""
    return re.sub(r"[\W\d_]", "", text)


def postcode(text: str | None) -> tuple[str, str]:
    """(area, postcode): the area is what a city shares, five digits or the letters in front."""
    text = (text or "").strip()
    if text.lower() in _MISSING:
        return "", ""
    if m := _UK.search(text):
        code = (m.group(1) + m.group(2)).upper()
        return re.match("[A-Z]+", code).group(), code
    digits = re.sub(r"\s", "", text).split("-")[0]
    if digits.isdigit() and 3 <= len(digits) <= 5:
        return digits.zfill(5), digits.zfill(5)
    return "", ""


def read(street: str | None, code: str | None, city: str | None, state: str | None) -> tuple | None:
    """(tokens, kind, number, unit, area, cities) of a record, or None if it has no street name or number.

    ``tokens``: the words of the street's name; ``cities``: the city as given, may be empty, then what else may be the city, the likeliest first.
    """
    area, _ = postcode(code)
    if not street or fold(street) in _MISSING:
        return None
    line, tail = street, ""
    found = [m for p in (_UK, _ZIP) for m in p.finditer(line)]
    if found:
        m = max(found, key=lambda m: m.start())
        area = area or postcode(m.group())[0]
        line, tail = line[: m.start()], line[m.end() :]
    if not line.isascii():
        line = "".join(c for c in unicodedata.normalize("NFKD", line.replace("ß", "ss")) if not unicodedata.combining(c))
    glued = " " not in line.strip()
    line = re.sub(r"(\d[A-D])(?=[A-Z][a-z])", r"\1 ", line)
    line = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", line)
    line = re.sub(r"(?<=\d)(?=[^\W\d_]{2})", " ", re.sub(r"(?<=[^\W\d_.])(?=\d)", " ", line)).lower()
    unit = ""
    if m := _UNIT.search(line):
        unit = m.group(1).lstrip("0") + (m.group(2) or "")
        line = line[: m.start()] + " , " + line[m.end() :]
    line = re.sub(r"\b(?:no|nr|num|numero)\b\.?\s*(?=\d)", " ", line).replace("#", " ")
    m = _NUMBER.search(line)
    if not m:
        return None
    number = m.group(1).lstrip("0") + (m.group(2) or m.group(3) or "")
    line = line[: m.start()] + " , " + line[m.end() :]
    if glued:  # written without spaces: a hyphen stands before a city or the kind of street
        line = re.sub(r"-([a-z]+)", lambda m: (" " if m.group(1) in _KIND else " , ") + m.group(1), line)
    parts = [p for p in (_words(p) for p in re.split(r"[,;]|\s-\s|\s-$|^-\s", line)) if p]
    if not parts:
        return None
    best = next((i for i, p in enumerate(parts) if _street(p)[1]), 0)
    tokens, kind = _street(parts[best])
    if not tokens:
        return None
    rest = ["".join(p) for i, p in enumerate(parts) if i != best]
    texts = [plain(tail), *(plain(x) for x in rest), plain(state)]
    return tokens, kind, number, unit, area, [plain(city), *dict.fromkeys(x for x in texts if x)]


def _words(part: str) -> list[str]:
    return [w for w in re.split(r"[\s.\-/'()\"]+", part) if w]


def _street(words: list[str]) -> tuple[list[str], str]:
    """(tokens of the name, kind) of the words of a street; kind is empty if there is none."""
    kind, left = "", []
    for i, w in enumerate(words):
        if not kind and w in _KIND and len(words) > 1:
            kind = _KIND[w]
        elif w not in _SMALL:
            left.append(w)
    if not kind and left:
        w = left[-1]
        for end, k in _ENDS:
            if w.endswith(end) and len(w) - len(end) >= 4:
                left[-1], kind = w[: -len(end)], k
                break
    if left and (not kind or len(left) == 1):
        w = left[0]
        for start, k in _STARTS:
            if w.startswith(start) and len(w) - len(start) >= 4 and kind in ("", k):
                left[0], kind = w[len(start) :], k
                break
    return [w for w in (re.sub(r"[\W\d_]", "", w) for w in left) if w], kind


_PARSED = "id bigint, tokens array<string>, kind string, number string, unit string, area string, cities array<string>"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, *fields in zip(*(c.to_pylist() for c in batch.columns)):
            if (got := read(*fields)) is not None:
                rows.append((i, *got))
        if rows:
            kinds = [pa.int64(), pa.list_(pa.string()), *[pa.string()] * 4, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _PARSED.split(", ")])


def deletions(column: str) -> Column:
    """A text and every form of it with one character left out; short texts only themselves."""
    return F.array_distinct(_forms(F.col(column)))


def _forms(text: Column) -> Column:
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.when(n >= 4, F.concat(F.array(text), cut)).otherwise(F.array(text))


def _localities(parsed: DataFrame, cut: Cut) -> DataFrame:
    """area, cities, places: the localities of every combination that occurs, by order of the evidence. Works on spellings and combinations, not on records.

    A city that is written as it should be leaves no other; otherwise the neighbouring spellings and the postcode's city stay.
    """
    spelled = cut(parsed.select("area", F.get("cities", F.lit(0)).alias("city")).filter("area <> '' and city <> ''").groupBy("area", "city").agg(F.count("*").alias("n")))
    of_area = cut(spelled.groupBy("area").agg(F.max_by("city", F.struct("n", "city")).alias("main"), F.max("n").alias("n")))
    leads = spelled.join(of_area.select("area", "main"), "area").groupBy("city").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("city") == F.col("main"), F.col("n")).otherwise(0)).alias("n"))
    # a state that stands in the city's place leads only areas that are misspelled
    mains = leads.filter("n * 2 >= all and n > 0").select("city", "n")
    # a spelling that leads some area by chance is a misspelling of a much more frequent neighbour
    forms = cut(mains.select("city", "n", F.explode(deletions("city")).alias("form")))
    worse = forms.select("form", F.col("city").alias("other"), F.col("n").alias("m")).join(forms, "form").filter("other <> city and n >= 10 * m").select(F.col("other").alias("city")).distinct()
    known = cut(mains.join(worse, "city", "left_anti"))
    near = forms.join(worse, "city", "left_anti").select("form", F.col("city").alias("near"), "n")

    combos = cut(parsed.select("area", "cities").distinct().withColumn("combo", F.xxhash64("area", "cities")))
    texts = combos.select("combo", "area", F.posexplode("cities").alias("at", "text")).filter("text <> ''")
    exact = texts.join(known.select(F.col("city").alias("text"), F.col("n").alias("m")), "text").select("combo", F.col("text").alias("locality"), F.when(F.col("m") >= 3, 0).otherwise(3).alias("way"), "at", F.lit(0).cast("bigint").alias("n"))
    tried = texts.join(exact.filter("way = 0").select("combo").distinct(), "combo", "left_anti")
    nearly = tried.select("combo", "area", "at", F.explode(deletions("text")).alias("form")).join(near, "form").join(of_area.select("area", "main"), "area", "left")
    nearly = nearly.select("combo", F.col("near").alias("locality"), F.when(F.col("near") == F.col("main"), 1).otherwise(3).alias("way"), "at", (-F.col("n")).alias("n"))
    by_area = combos.join(of_area, "area").join(known.select(F.col("city").alias("main"), F.lit(True).alias("ok")), "main", "left")
    by_area = by_area.select("combo", F.col("main").alias("locality"), F.when(F.col("ok"), 2).otherwise(4).alias("way"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n"))
    itself = combos.select("combo", F.coalesce(F.nullif(F.get("cities", F.lit(0)), F.lit("")), F.nullif("area", F.lit("")), F.get("cities", F.lit(1)), F.lit("")).alias("locality"), F.lit(5).alias("way"), F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("n"))
    found = exact.unionByName(nearly).unionByName(by_area).unionByName(itself).groupBy("combo").agg(F.array_sort(F.collect_set(F.struct("way", "at", "n", "locality"))).alias("found"))
    first = F.col("found")[0]
    others = F.filter("found", lambda x: (first["way"] > 0) & (x["way"] <= 3))
    places = F.array_distinct(F.concat(F.array(first["locality"]), F.transform(others, lambda x: x["locality"])))
    return combos.join(found.select("combo", places.alias("places")), "combo").select("area", "cities", "places")


def _street_names(readings: DataFrame, cut: Cut) -> DataFrame:
    """locality, name, usual: of a rare spelling the much more frequent one of the same locality in its neighbourhood."""
    names = readings.groupBy("locality", "name").agg(F.count("*").alias("n"))
    forms = cut(names.select("locality", "name", "n", F.explode(deletions("name")).alias("form")))
    other = forms.select("locality", "form", F.col("name").alias("usual"), F.col("n").alias("m"))
    better = forms.join(other, ["locality", "form"]).filter("name <> usual and m >= 2 * n")
    return better.groupBy("locality", "name").agg(F.max_by("usual", F.struct("m", "usual")).alias("usual"))


def assignment(cost: list[list[float]]) -> float:
    """The least total cost of giving each row a column of its own (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, seen, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            seen[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return -v[0]


def _near(a: str, b: str) -> bool:
    """Whether two words share a form of their deletion neighbourhoods."""
    if a == b:
        return True
    forms = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w) if len(w) >= 4 else 0))}
    return not forms(a).isdisjoint(forms(b))


def tokens_off(a: list[str], b: list[str]) -> int | None:
    """How many tokens of two names differ, each at most an edit or transposition away, in any order; None if the names are not the same."""
    if len(a) != len(b):
        return None
    far = len(a) + 1
    cost = assignment([[0 if x == y else 1 if _near(x, y) else far for y in b] for x in a])
    return int(cost) if cost < far else None


def same_street(a: list[str], b: list[str]) -> bool:
    """Whether the tokens of two names are the same, each at most an edit or transposition away, in any order."""
    return tokens_off(a, b) is not None


def _assign_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``tokens`` and ``like`` are the same, with the cost in place of the two."""
    for batch in batches:
        off = pa.array([tokens_off(x, y) for x, y in zip(batch["tokens"].to_pylist(), batch["like"].to_pylist())], pa.int32())
        kept = batch.drop_columns(["tokens", "like"])
        yield pa.RecordBatch.from_arrays([*kept.columns, off], names=[*kept.schema.names, "off"]).filter(off.is_valid())


def _token_pairs(words: DataFrame, cut: Cut) -> DataFrame:
    """reading, turn, kind, b, only, off: the readings and those of a first locality (b, of kind ``only``) that are the same by their tokens.

    Two names of one kind and two tokens are the same if they share a key, so each is paired with the least of its key; all others are paired.
    """
    name, of = ["block", "size", "reading", "turn", "kind", "tokens"], Window.partitionBy("block", "size", "form")
    held = words.withColumn("size", F.size("tokens")).select(*name, F.posexplode("tokens").alias("at", "token")).select(*name, "at", F.explode(deletions("token")).alias("form"))
    held = held.select("*", F.count("*").over(of).alias("m"), F.bit_xor(F.xxhash64("reading", "turn", "tokens", "at")).over(of).alias("holders")).filter("m > 1")
    # of forms that the same tokens have one will do; a name with a token of its own is like no other
    held = held.groupBy(*name, "at", "m", "holders").agg(F.min("form").alias("form"))
    held = held.groupBy(*name, "at").agg(F.sum("m").alias("m"), F.collect_list("form").alias("forms"))
    held = held.groupBy(*name).agg(F.array_sort(F.collect_list(F.struct("m", "at", "forms"))).alias("held")).filter(F.size("held") == F.col("size"))
    two = held.select(*name, "held", F.posexplode("held").alias("i", "x")).select(*name, "i", "x", F.posexplode("held").alias("j", "y")).filter("i < j")
    rarest = ((F.col("i") == 0) & (F.col("j") == 1)).alias("rarest")
    two = two.select(*name, rarest, "y", F.explode("x.forms").alias("f")).select(*name, "rarest", "f", F.explode("y.forms").alias("g"))
    keys = cut(two.select(*name, "rarest", F.concat_ws("+", F.least("f", "g"), F.greatest("f", "g")).alias("key")))
    first = keys.filter("turn = 0").select("block", "size", "key", F.col("reading").alias("b"), F.col("kind").alias("only"), F.col("tokens").alias("like"))
    first = first.withColumn("least", F.min("b").over(Window.partitionBy("block", "size", "key", "only")))
    fits = "reading <> b and if(turn = 0, kind = only and reading > b and (size > 2 or b = least) or kind = '' and only <> '', kind = only or kind = '' or only = '')"
    tried = keys.filter("rarest").join(first, ["block", "size", "key"]).filter(fits).select("reading", "turn", "kind", "b", "only", "tokens", "like").distinct()
    same = tried.mapInArrow(_assign_tokens, "reading bigint, turn int, kind string, b bigint, only string, off int")
    return cut(same.groupBy("reading", "turn", "kind", "b", "only").agg(F.min("off").alias("off")))


#: Links that one task closes to groups; of more, labels are spread in rounds over all executors.
SMALL = 1 << 19


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, group of the links that one task holds."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    a, b = (np.concatenate([np.asarray(x.column(i)) for x in got]) for i in (0, 1))
    ids, code = np.unique(np.r_[a, b], return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        while not np.array_equal(ahead := new[new], new):
            new = ahead
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "group"])


def _groups(links: DataFrame, cut: Cut, small: int = SMALL) -> DataFrame:
    """id, group: the least id of the connected component; labels take the least of their neighbours' and jump ahead."""
    links = cut(links.select("a", "b").distinct(), n=F.count("*"))
    if links._millrace_n <= small:
        return links.repartition(1).mapInArrow(_close, "id bigint, `group` bigint")
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("group")))
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("least"))
        near = label.join(seen, "id").select("id", "group", F.least("group", "least").alias("new"))
        jump = near.join(label.select(F.col("id").alias("new"), F.col("group").alias("ahead")), "new", "left")
        step = cut(jump.select("id", F.least("new", "ahead").alias("group"), (F.least("new", "ahead") < F.col("group")).alias("moved")), moved=F.count_if(F.col("moved")))
        cut.drop(label)
        label = step
        if not step._millrace_moved:
            return label.select("id", "group")


def same_places(records: DataFrame, key: str = "location_id", street: str = "street_address", code: str = "postal_code", city: str = "city", state: str = "state_province", small: int = SMALL) -> DataFrame:
    """id, group: the records that share their place with another id; one group a place."""
    cut = Cut(records.sparkSession, "addresses")
    narrow = records.select(F.col(key).cast("bigint").alias("id"), *(F.col(c).cast("string").alias(n) for c, n in ((street, "s"), (code, "p"), (city, "c"), (state, "t")))).filter("id is not null").distinct()
    parsed = cut(narrow.mapInArrow(_read_batches, _PARSED))
    local = parsed.join(_localities(parsed, cut), ["area", "cities"]).withColumn("name", F.array_join("tokens", "")).withColumn("locality", F.col("places")[0])
    # a reading: what is left of a record; equal readings are one place, whatever their number
    reading = F.xxhash64("locality", "number", "unit", "name", "kind")
    read_as = cut(local.select("id", reading.alias("reading"), "locality", "number", "unit", "tokens", "name", "kind", F.when(F.size("places") > 1, F.slice("places", 2, F.size("places"))).alias("others")))
    block = F.xxhash64("locality", "number", "unit").alias("block")
    parts = ("locality", "number", "unit", "name", "kind")
    readings = cut(read_as.groupBy("reading").agg(*(F.first(c).alias(c) for c in parts), F.count("*").alias("n")))
    named = readings.join(_street_names(readings, cut), ["locality", "name"], "left").select("reading", F.lit(0).alias("turn"), "name", "kind", "n", F.coalesce("usual", "name").alias("usual"), block)
    other = read_as.filter("others is not null").select("reading", "number", "unit", "name", "kind", F.posexplode("others").alias("turn", "locality"))
    other = other.select("reading", (F.col("turn") + 1).alias("turn"), "name", "kind", F.lit(1).cast("bigint").alias("n"), F.col("name").alias("usual"), block).distinct()
    forms = F.array_distinct(F.concat(deletions("name"), F.array(F.concat(F.lit("="), F.col("usual")))))
    index = named.unionByName(other).select("reading", "turn", "name", "kind", "n", "block", F.explode(forms).alias("form"))
    # forms that one reading has for itself, by far the most, go at once; the rest stays where it is
    shared = cut(index.withColumn("all", F.count("*").over(Window.partitionBy("block", "form"))).filter("all > 1").drop("all"))
    settled = shared.filter("turn = 0")
    # a star instead of all pairs: readings of one kind that share a form are linked to the least of them
    kept = cut(settled.withColumn("b", F.min("reading").over(Window.partitionBy("block", "form", "kind"))).filter("reading <> b").select(F.col("reading").alias("a"), "b").distinct())
    # one name may be written in several ways of words, which are all tried
    places = F.concat(F.array("locality"), F.coalesce("others", F.array().cast("array<string>")))
    words = read_as.filter(F.size("tokens") > 1).select("reading", "number", "unit", "tokens", "kind", F.posexplode(places).alias("turn", "locality"))
    alike = _token_pairs(words.select("reading", "turn", "tokens", "kind", block).distinct(), cut)
    matched = alike.filter("turn = 0 and kind = only").select(F.col("reading").alias("a"), "b")
    inside = cut(_groups(kept.unionByName(matched), cut, small))
    # a first locality stands for all readings linked there if a record of one of them points to no other
    sure = read_as.filter("others is null").select("reading").distinct()
    holds = sure.join(inside.withColumnRenamed("id", "reading"), "reading").select("group").distinct()
    settles = cut(inside.join(holds, "group", "left_semi").select(F.col("id").alias("reading")).unionByName(sure).distinct())
    # open readings go to one candidate only: the locality and kind of street that cost least
    opened = settled.filter("kind = ''").unionByName(shared.filter("turn > 0").join(settles, "reading", "left_anti").select(settled.columns))
    leads = settled.select("block", "form", F.col("kind").alias("only"), F.col("reading").alias("b"), F.col("name").alias("like"), F.col("n").alias("m"))
    fits = F.when(F.col("turn") == 0, F.col("only") != "").otherwise((F.col("kind") == F.col("only")) | (F.col("kind") == "") | (F.col("only") == ""))
    near = opened.join(leads, ["block", "form"]).filter(fits & (F.col("b") != F.col("reading"))).groupBy("reading", "turn", "kind", "only", "block", "form")
    near = near.agg(F.min("b").alias("b"), F.min(F.levenshtein("name", "like")).alias("off"), F.sum("m").alias("m")).drop("block", "form")
    by_tokens = alike.filter("turn = 0 and kind <> only").unionByName(alike.filter("turn > 0").join(settles, "reading", "left_anti").select(alike.columns))
    by_tokens = by_tokens.join(readings.select(F.col("reading").alias("b"), "n"), "b").withColumn("m", F.sum("n").over(Window.partitionBy("reading", "turn", "only", "off"))).drop("n")
    near = cut(near.unionByName(by_tokens).withColumn("unlike", F.col("kind") != F.col("only")).drop("kind").distinct())
    chosen = near.groupBy("reading").agg(F.min(F.struct("turn", "off", "unlike", -F.col("m"), "only")).alias("c")).select("reading", "c.turn", "c.only")
    assigned = near.join(chosen, ["reading", "turn", "only"]).select(F.col("reading").alias("a"), "b")
    for end in ("a", "b"):
        assigned = assigned.join(inside.select(F.col("id").alias(end), "group"), end, "left").withColumn(end, F.coalesce("group", end)).drop("group")
    placed = read_as.select("id", "reading").join(inside.withColumnRenamed("id", "reading"), "reading", "left").select("id", F.coalesce("group", "reading").alias("group")).distinct()
    # open readings and deliveries of one id that read differently tie their groups together
    several = cut(placed).withColumn("lowest", F.min("group").over(Window.partitionBy("id")))
    ties = several.filter("group <> lowest").select(F.col("group").alias("a"), F.col("lowest").alias("b"))
    tied = _groups(ties.unionByName(assigned.filter("a <> b")), cut, small)
    members = several.join(tied.select(F.col("id").alias("group"), F.col("group").alias("top")), "group", "left").select("id", F.coalesce("top", "group").alias("group")).distinct()
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    return cut(members.join(sizes, "group").select("id", "group"))


def pairs_of(groups: DataFrame) -> DataFrame:
    """id_a, id_b: every pair inside a group, the smaller id first."""
    other = groups.select(F.col("id").alias("id_b"), "group")
    return groups.select(F.col("id").alias("id_a"), "group").join(other, "group").filter("id_a < id_b").select("id_a", "id_b")
