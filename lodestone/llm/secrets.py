"""Secret scan: three fixed patterns, and character Markov models of random strings against ordinary identifiers.

All of it is DataFrame functions. Both models are bigram chains over printable ASCII,
counted from labelled samples; what the workers get is one array with the log-likelihood
ratio of every bigram (95 * 95 numbers whatever the corpus). A string of TOKEN characters
or more is a secret where its mean ratio passes a threshold, which is taken from the
ordinary samples' own scores; so is a part of a string, between signs, of PART characters
or more, against a threshold of that length. Shorter strings are outside the models.
Found strings that touch a pattern's span are left out.

Positions come from splitting a text at the matches: the pieces' lengths and the
matches' lengths add up to code points. Spans are gathered some at a time, so the work
follows their number.

Defined results: null text is as empty (no spans); repeated rows each get their own.
Columns of any name stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the patterns, in the order that ties between kinds take
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov", "markov")
#: What an assignment must show in the text for the pattern to be tried: any keyword, and its sign.
_SIGN = r"""(?:[dD]|[tTnNyY])["']?\x20*[:=]"""

#: Characters that a string, or a part of one, has at least to be scored, and the alphabets of both.
TOKEN, PART = 20, 16
STRING = r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN
PART_STRING = r"[A-Za-z0-9+]{%d,}" % PART
#: Labelled samples of each kind that the default models are trained on.
SAMPLES = 6000
#: Share of ordinary samples that may score above the threshold.
ORDINARY_ABOVE = 0.001

# fixed values: parts of ordinary identifiers
_PARTS = (
    "account active address after amount archive array async audit balance batch before binary block body buffer build "
    "bundle button cache callback cancel channel check child class client close code collection column command commit "
    "component config connect constant container content context control convert copy count create current customer data "
    "database date debug decode default delete delta device dialog digest direct display document domain download driver "
    "duration dynamic element enable encode engine entity entry error event example execute export factory field file "
    "filter final finish first flag folder format frame function generate global graph group handler header height history "
    "identifier image import index info initial input insert install instance integer interface internal invoice item key "
    "language last layout length level library limit line link list listener load local location logger login manager map "
    "master match member memory menu message method metric migration mobile model module monitor network next node note "
    "number object offset open option order origin output package page panel parent parse partition pattern payload "
    "payment pending permission platform player policy position prefix previous price primary process product profile "
    "program project property protocol provider proxy public query queue random range read record reference refresh region "
    "register release remote remove render report request reset resource response result return root route sample schema "
    "scope screen script search section select sender server service session setting shared signal size source stack "
    "start state static status storage stream string style submit summary support switch symbol system table target task "
    "template test text thread time title token total trace transaction transform trigger type update upload user utility "
    "valid value variable vector verify version video view visible warning width window worker wrapper write"
).split()

# fixed values: common words of some languages, as far as they are ASCII
_WORDS = (
    "about after again because before between could every first great house large might never other people place right should small sound spell still "
    "study their there these thing think those thought three through under water where which while whose without world would write years young "
    "aber auch auf beide durch einer erst ganz gegen gleich haben heute heit immer jetzt jahr kein keit kopf leben lich machen mehr mensch mit nach "
    "nicht noch oder ohne pfad pferd pflanze platz recht satz schaft schnell schon schreiben schwarz selbst sich sie sitzen sprache stadt tag "
    "tropfen ung unter viel von vor wasser weg weil welt werden wichtig wieder wissen zeit zeitung zu zukunft zum zur zwischen zwei zuletzt "
    "alors aucun aussi autre aux avant avec beaucoup bien bureau cadeau ceux chaque chose comme contre dans depuis deux dieux doux eau elle encore entre "
    "eux faire femme fois gauche heureux homme jeu jour lieu lui maintenant mais mieux moins monde mot nous nouveau oiseau oui ouvrir parce pays peu peut "
    "plus pour quand quatre que quel qui quoi rien sans sous sur tableau temps tout toujours travail trois trouver vers vieux voix vous yeux "
    "ahora algo antes aquel asi bajo bien cada casa caja como cosa cuando cuatro desde dia donde ella ellos entonces entre era eso esta este fue gente hacer "
    "hasta hijo hoja hombre jamas lejos llamar llegar lluvia lugar mano mayor mejor mente mesa mientras mismo mucho mundo nada noche nombre nosotros nuevo "
    "nunca ojos otro palabra para parte pero poco porque pueblo quien seguir ser siempre sobre solo suyo tanto tiempo todo trabajo tres uno usted vez viaje vida yo zona"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES, seed: str = "sample") -> DataFrame:
    """(text, label): n random strings (1) in the usual encodings, n ordinary identifiers (0) put together from words; others for another seed."""
    parts = F.split(F.lit(" ".join(_PARTS)), " ")
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 512)
    raw = F.base64(F.unhex(digest))
    size = (F.lit(TOKEN) + F.col("id") % 29).cast("int")
    random = F.when(F.col("id") % 4 == 0, digest.substr(F.lit(1), size)).when(F.col("id") % 4 == 1, F.upper(F.translate(raw, "+/=", "ABC")).substr(F.lit(1), size)).otherwise(raw.substr(F.lit(1), size))

    def part(k: int) -> Column:
        return F.element_at(parts, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(len(_PARTS))) + 1).cast("int"))

    plain = F.split(F.lit(" ".join(_WORDS)), " ")
    run = [F.element_at(plain, (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(len(_WORDS))) + 1).cast("int")) for k in range(4, 11)]
    words = [part(k) for k in range(4)]
    kind = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(11)), F.lit(6))
    number = F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(2030)).cast("string")).otherwise(F.lit(""))
    ordinary = (
        F.when(kind == 0, F.concat_ws("_", *words))
        .when(kind == 1, F.concat(words[0], *[F.initcap(w) for w in words[1:]]))
        .when(kind == 2, F.upper(F.concat_ws("_", *words[:3])))
        .when(kind == 3, F.concat_ws("/", *words))
        .when(kind == 4, F.concat_ws("-", *words[:3]))
        .otherwise(F.concat(*words))
    )
    ids = spark.range(n, numPartitions=4)
    # every third ordinary string is a run of plain words
    ordinary = F.when(F.col("id") % 3 == 1, F.concat(*run)).otherwise(F.concat(ordinary, number))
    return ids.select(random.alias("text"), F.lit(1).alias("label")).union(ids.select(ordinary.alias("text"), F.lit(0).alias("label")))


def _ratio_of(text: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of the bigrams of a string over printable ASCII."""
    def cell(i: Column) -> Column:
        return (F.ascii(F.substring(text, i, 1)) - 32) * 95 + F.ascii(F.substring(text, i + 1, 1)) - 31

    n = F.length(text) - 1
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + F.element_at(ratios, cell(i))) / n


class Models:
    """The ratio of every bigram, and the thresholds for strings and for parts."""

    def __init__(self, samples: DataFrame) -> None:
        """samples: (text, label) with label 1 for random strings; other than printable ASCII and short texts are left out."""
        clean = samples.where(F.length("text") >= 2).where(~F.col("text").rlike(r"[^\x20-\x7e]"))
        pairs = clean.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, 2))).alias("pair"))
        counts = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
        heads: dict[tuple[int, str], int] = {}
        for (label, pair), n in counts.items():
            heads[label, pair[0]] = heads.get((label, pair[0]), 0) + n
        signs = [chr(c) for c in range(32, 127)]
        cells = []
        for a in signs:
            for b in signs:
                one, none = ((counts.get((k, a + b), 0) + 0.05) / (heads.get((k, a), 0) + 0.05 * 95) for k in (1, 0))
                cells.append(f"{math.log(one / none):.3f}")
        self.ratios = F.split(F.lit(",".join(cells)), ",").cast("array<double>")
        short = F.substring(F.regexp_replace("text", "[^A-Za-z0-9+]", ""), 1, PART)
        scored = clean.where("label = 0").select(_ratio_of(F.col("text"), self.ratios).alias("s"), F.when(F.length(short) == PART, _ratio_of(short, self.ratios)).alias("p"))
        bars = scored.agg(*(F.percentile(c, F.lit(1 - ORDINARY_ABOVE)) for c in "sp")).first()
        self.threshold, self.part_threshold = (max(0.0, x or 0.0) for x in bars)


_SPAN = "array<struct<s:int,e:int,k:int>>"
#: Spans that are put together before they are set aside.
_TOGETHER = 256


def _gather(items: Column, at: Column, move, keep, value) -> Column:
    """The values of the items that keep accepts; at is carried along by move. No list longer than _TOGETHER is ever copied to add to it."""
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["open"]) >= _TOGETHER
        open_ = F.when(full, none).otherwise(acc["open"])
        done = F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(move(acc["at"], x).alias("at"), done.alias("done"), F.when(keep(acc["at"], x), F.concat(open_, F.array(value(acc["at"], x)))).otherwise(open_).alias("open"))

    start = F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("done"), none.alias("open"))
    return F.aggregate(items, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["open"]))))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that keep accepts; keep gets the match and its second group."""
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if kind else 2)).alias("part"),
    )
    begin = lambda at, x: at + F.length(x["gap"])
    end = lambda at, x: begin(at, x) + F.coalesce(F.length(x["hit"]), F.lit(0))
    return _gather(found, F.lit(0), end, lambda at, x: keep(x["hit"], x["part"]), lambda at, x: F.struct(begin(at, x).alias("s"), end(at, x).alias("e"), F.lit(kind).alias("k")))


def _apart(spans: Column, fixed: int) -> Column:
    """spans, sorted by start and kind, without those of kind fixed or higher that touch one of a lower kind."""
    lower = lambda x: x["k"] < fixed
    same = lambda at, x: x
    ahead = _gather(spans, F.lit(0), lambda at, x: F.when(lower(x), F.greatest(at, x["e"])).otherwise(at), lambda at, x: lower(x) | (x["s"] >= at), same)
    back = _gather(F.reverse(ahead), F.lit(2**31 - 1), lambda at, x: F.when(lower(x), F.least(at, x["s"])).otherwise(at), lambda at, x: lower(x) | (x["e"] <= at), same)
    return F.reverse(back)


def find(docs: DataFrame, models: Models, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep (a struct, so that no name can clash), text, and base and found: the patterns' spans and all, sorted by start, then kind."""
    yes = lambda hit, part: hit.isNotNull()
    random = lambda least: lambda hit, part: F.when(hit.isNotNull(), _ratio_of(hit, models.ratios) > least).otherwise(False)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))

    def only(test: Column, spans: Column) -> Column:
        return F.when(test, spans).otherwise(F.array().cast(_SPAN))

    assign = only(text.rlike(_SIGN), _spans(text, ASSIGN, 0, lambda hit, part: F.coalesce(F.length(part) >= 6, F.lit(False))))
    access = only(text.contains("AKIA"), _spans(text, ACCESS, 1, yes))
    hexes = only(text.rlike(HEX), _spans(text, HEX, 2, yes))
    whole = only(text.rlike(STRING), _spans(text, STRING, 3, random(models.threshold)))
    parts = only(text.rlike(PART_STRING), _spans(text, PART_STRING, 4, random(models.part_threshold)))
    out = out.withColumn("base", F.array_sort(F.concat(assign, access, hexes))).withColumn("more", F.concat(whole, parts))
    some = F.size("more") > 0
    found = F.when(some, _apart(_apart(F.array_sort(F.concat("base", "more")), 3), 4)).otherwise(F.col("base"))
    return out.withColumn("found", found).drop("more")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def report(docs: DataFrame, models: Models, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""
    found = find(docs, models, [id_col])

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select(F.col(f"row.`{id_col}`").alias(id_col), *[count(k) for k in range(3)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))


def redact(docs: DataFrame, models: Models, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by the mark (spans that overlap become one), and n_chars, where there is one, to match."""
    text = F.col("text")
    # what lies between the spans; one that begins within those before it only reaches further
    between = _gather(F.col("found"), F.lit(0), lambda at, x: F.greatest(at, x["e"]), lambda at, x: x["s"] >= at, lambda at, x: F.struct(at.alias("s"), x["s"].alias("e"), F.lit(0).alias("k")))
    rest = F.substring(text, F.array_max(F.transform("found", lambda x: x["e"])) + 1, F.length(text))
    changed = F.size("found") > 0
    out = find(docs, models, docs.columns).withColumn("between", F.when(changed, between))
    gaps = F.transform("between", lambda x: F.substring(text, x["s"] + 1, x["e"] - x["s"]))
    out = out.withColumn("clean", F.when(changed, F.array_join(F.concat(gaps, F.array(rest)), mark)).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)
