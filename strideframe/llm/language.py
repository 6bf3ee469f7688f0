"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per row:

* the text: likelihood under byte-trigram models, one per language, and a flat model for "no known language" (``und``);
* the language that the markup declares, as often wrong as the data show: P(declared | language);
* the suffix of the address: P(suffix | language);
* the prior of the host, smoothed towards its domain's, which is smoothed towards the prior of all rows.

The tables behind the last three are grouped sums of the text posteriors (a row's own is taken out of its host's).  They
have one row per declared value, suffix or host; a frequent value costs one row per task in the aggregation, and a join whose
skewed side can be split (or a broadcast, where the written table is small enough for Spark's limit).

The text models are fit on a bounded sample of labelled rows: about ``SAMPLE`` of each label, drawn by a hash of the text, rarer
labels whole.  Every label with any trigram gets a model; more than ``MOST_LANGUAGES`` labels are an error.

Defined results: a null text is empty; a text without three letters in a row gives no evidence; missing evidence (null or empty
declaration, address or host) counts for nothing; a row whose best language is ``und`` or whose posterior is under ``SURE`` is
rejected; without labelled rows every row is ``und``; repeated rows are judged alike; extra columns are kept; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.shared import as_text, decoding_few, in_arrow, written

UNKNOWN = "und"
SAMPLE, MOST_LANGUAGES, BUCKET_BITS, HELD = 4000, 256, 16, 16
TEMPER, UNKNOWN_PRIOR, SMOOTH, HOST_WEIGHT, SURE = 0.2, 0.01, 1.0, 10.0, 0.5
MULTIPLIER = np.uint32(2654435761)


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of each byte trigram of letters and blanks; A-Z count as a-z, white space as one blank.

    Digits, punctuation and the like (numbers, addresses, keys) say nothing about a language: trigrams with them are left out."""
    fold = FOLD[np.frombuffer(text, np.uint8)]
    if len(fold) < 3:
        return np.empty(0, np.uint32)
    code = (fold[:-2] << np.uint32(16)) | (fold[1:-1] << np.uint32(8)) | fold[2:]
    letters = fold > 0
    code = code[letters[:-2] & letters[1:-1] & letters[2:]]
    return (code * MULTIPLIER) >> np.uint32(32 - BUCKET_BITS)


FOLD = np.zeros(256, dtype=np.uint32)  # 0: no letter
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
FOLD[[32, *range(9, 14)]] = 32


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # UNKNOWN is the last
    table: np.ndarray  # log-likelihood per bucket and language


@decoding_few
def train(rows: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Trigram models of all labels, from a bounded sample of each: about ``sample`` rows, or all of a label that has fewer."""
    known = rows.filter(F.col(label).isNotNull() & (F.col(label) != UNKNOWN)).select(F.col(label).alias("label"), as_text(text).alias("text"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    tally = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(tally) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: merge some (regions, spellings) before training, none is left out")
    # where one text makes up a label, the share may miss it: the smallest draw is always in
    upto = {r["label"]: max(int(min(1.0, sample / r["n"]) * (1 << 30)), r["least"]) for r in tally}
    bounds = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair]) if upto else F.lit(None).cast("map<string,bigint>")
    drawn = known.filter(draw <= bounds[F.col("label")])  # the documented sample
    kinds = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def tables(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], schema=kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1)):
                sums[label] = sums.get(label, 0) + np.bincount(trigrams(text.as_py().encode()), minlength=1 << BUCKET_BITS)
                if len(sums) > HELD:
                    yield from tables(sums)
                    sums = {}
        yield from tables(sums)

    counts = written(in_arrow(drawn, count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    top = [r["label"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").collect()]
    got = counts.toPandas()  # MOST_LANGUAGES * 2 ** BUCKET_BITS rows at most
    table = np.zeros((1 << BUCKET_BITS, len(top) + 1))
    table[got["bucket"], got["label"].map({x: i for i, x in enumerate(top)}).to_numpy(dtype=int)] = got["n"]
    flat = 1 / (1 << BUCKET_BITS)
    table[:, :-1] = np.log((table[:, :-1] + 200 * flat) / (table[:, :-1].sum(0) + 200))
    table[:, -1] = np.log(flat)
    return Model((*top, UNKNOWN), table.astype(np.float32))


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``ll array<double>``, one per language, to rows with a ``_text``, which goes."""
    out = [f for f in rows.schema if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", ll array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("_text")
            ll = [model.table[trigrams(t.as_py().encode())].sum(0, dtype=np.float64) for t in b.column(at)]
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            names = [n for n in b.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ll, pa.list_(pa.float64()))], names=[*names, "ll"])

    return in_arrow(rows, run, schema)


def host_of(url: Column) -> Column:
    """The host in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def visible_text(html: Column) -> Column:
    """What is left of a page without scripts, styles, comments, tags and entities."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")


def declared_in(html: Column) -> Column:
    """The ``lang`` of the html element, without its region; null where there is none."""
    lang = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    return F.when(lang != "", lang)


def normalised(logs: str) -> Column:
    """Probabilities from an array of their unnormalised logarithms."""
    scaled = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))


@decoding_few
def identify(rows: DataFrame, model: Model, text: Column, declared: Column | None = None, host: Column | None = None,
             carry: list[str] | None = None, sure: float = SURE) -> DataFrame:
    """The columns ``carry`` of ``rows`` (all of them by default), then ``language, posterior, text_language, kept``.

    What is carried goes along in written tables as one struct, so it may have any names; carry ids where that will do."""
    carry = rows.columns if carry is None else carry
    n = len(model.languages)
    none = F.lit(None).cast("string")
    host = none if host is None else host
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                      as_text(text).alias("_text"), (none if declared is None else declared).alias("declared"), host.alias("host"))
    own = own.withColumn("domain", F.when(F.col("host").contains("."), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.col("host")))
    own = own.withColumn("suffix", F.when(F.col("host").contains("."), F.regexp_extract("host", r"\.([^.]+)$", 1)))
    own = likelihoods(own, model)
    start = [np.log(UNKNOWN_PRIOR) if x == UNKNOWN else np.log((1 - UNKNOWN_PRIOR) / max(1, n - 1)) for x in model.languages]
    own = own.withColumn("logs", F.array(*[F.col("ll")[i] * TEMPER + float(start[i]) for i in range(n)]))
    # hardly a value comes twice: dictionaries of them would only fill the writer's memory
    own = written(own.withColumn("soft", normalised("logs")).drop("logs"), "likelihoods", **{"parquet.enable.dictionary": "false"})

    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]
    total = written(own.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"g{i}") for i, s in enumerate(sums)]), "all").first()  # one row
    count = max(sum(total), 1e-9)
    prior = [(total[i] + SMOOTH) / (count + SMOOTH * n) for i in range(n)]

    def evidence(name: str) -> DataFrame:
        """log P(value | language) of each value, smoothed towards the value's share of all rows."""
        t = own.filter(F.col(name).isNotNull()).groupBy(name).agg(*sums)
        share = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0")) / count
        return written(t.select(name, F.array(*[F.log((F.col(f"s{i}") + SMOOTH * share) / (total[i] + SMOOTH)) for i in range(n)]).alias(f"{name}_ll")), name)

    by_host = written(own.filter("host is not null").groupBy("domain", "host").agg(*sums), "hosts")
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    size = sum((F.col(f"d{i}") for i in range(1, n)), F.col("d0"))
    by_domain = by_domain.select("domain", *[((F.col(f"d{i}") + HOST_WEIGHT * prior[i]) / (size + HOST_WEIGHT)).alias(f"p{i}") for i in range(n)])
    hosts = written(by_host.join(by_domain, "domain").select(F.col("host"), F.array(*[F.col(f"s{i}") for i in range(n)]).alias("of_host"),
                                                             F.array(*[F.col(f"p{i}") for i in range(n)]).alias("of_domain")), "host-priors")
    own = own.join(hosts, "host", "left").join(evidence("declared"), "declared", "left").join(evidence("suffix"), "suffix", "left")

    rest = F.aggregate("of_host", F.lit(0.0), lambda a, b: a + b) - 1  # without the row itself
    logs = []
    for i in range(n):
        from_host = (F.greatest(F.col("of_host")[i] - F.col("soft")[i], F.lit(0.0)) + HOST_WEIGHT * F.col("of_domain")[i]) / (F.greatest(rest, F.lit(0.0)) + HOST_WEIGHT)
        logs.append(F.log(F.coalesce(from_host, F.lit(float(prior[i])))) + F.col("ll")[i] * TEMPER
                    + F.coalesce(F.col("declared_ll")[i], F.lit(0.0)) + F.coalesce(F.col("suffix_ll")[i], F.lit(0.0)))
    own = own.select("row", "ll", F.array(*logs).alias("logs")).withColumn("post", normalised("logs"))
    names = F.array(*map(F.lit, model.languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    own = own.select("row", best(F.col("post")).alias("language"), F.array_max("post").alias("posterior"), best(F.col("ll")).alias("text_language"))
    keep = (F.col("language") != UNKNOWN) & (F.col("posterior") >= sure)
    verdict = own.withColumn("kept", keep)
    return verdict.select(*[F.col("row").getField(c).alias(c) for c in carry], "language", "posterior", "text_language", "kept")
