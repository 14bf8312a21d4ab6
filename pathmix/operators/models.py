"""Count-based predictors. Each turns matched contexts into distributions by expressions on one row; the only
shuffles are those of `windows.match`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributions as D
from . import windows as W


def counted(paths: DataFrame, highest: int) -> DataFrame:
    return W.rows_of(W.ngrams(paths, highest))


def sizes(paths: DataFrame) -> DataFrame:
    """One row: the number of distinct nodes of all paths."""
    return paths.select(F.explode("path").alias("node")).agg(F.countDistinct("node").alias("size"))


def unigram(paths: DataFrame) -> DataFrame:
    """One row: the distribution of all targets without context, and the number of distinct nodes of all paths."""
    return _constants(W.ngrams(paths, 0, 0), sizes(paths))


def _constants(counts: DataFrame, size: DataFrame) -> DataFrame:
    base = W.rows_of(counts).select(F.lit(0).alias("_one"), D.from_counts(F.struct("n", "nexts")).alias("uni"))
    return size.withColumn("_one", F.lit(0)).join(base, "_one", "left")


def _with_constants(found: DataFrame, constants: DataFrame) -> DataFrame:
    """Adds size (of the vocabulary) and uni; one row is sent to every task, its length the vocabulary's."""
    return found.withColumn("_one", F.lit(0)).join(F.broadcast(constants), "_one", "left").drop("_one")


def prepare(train: DataFrame, contexts: DataFrame, highest: int) -> DataFrame:
    """ctx, found, size, uni, mc1 for each distinct context: what all predictors need."""
    return _prepared(counted(train, max(highest, 1)), unigram(train), contexts, highest)


def prepare_counts(counts: DataFrame, size: DataFrame, contexts: DataFrame, highest: int) -> DataFrame:
    """`prepare` from counts (k from 0, ctx, next, cnt) and one row with the size of the vocabulary."""
    return _prepared(W.rows_of(counts.where(F.col("k").between(1, max(highest, 1)))), _constants(counts.where("k = 0"), size), contexts, highest)


def _prepared(table: DataFrame, constants: DataFrame, contexts: DataFrame, highest: int) -> DataFrame:
    found = _with_constants(W.match(contexts.select("ctx").distinct(), table, max(highest, 1)), constants)
    ones = F.filter("found", lambda m: m["k"] == 1)
    flat = D.empty(1.0 / F.col("size"))
    return found.withColumn("mc1", F.when(F.size(ones) > 0, D.from_counts(F.get(ones, F.lit(0)))).otherwise(flat))


def _up_to(k: int) -> Column:
    return F.filter("found", lambda m: m["k"] <= k)


def _fall_back() -> Column:
    return F.coalesce("uni", D.empty(1.0 / F.col("size")))


def backoff(k: int) -> Column:
    """The longest matched context of at most k nodes; without one the unigram, without any the uniform."""
    use = _up_to(k)
    return F.when(F.size(use) > 0, D.from_counts(F.element_at(use, -1))).otherwise(_fall_back())


def weighted(k: int, tau: float = 8.0, power: float = 1.0) -> Column:
    """All matched orders, weighted by evidence (n / (n + tau)) ** power over entropy in bits."""
    parts = F.transform(_up_to(k), lambda m: F.struct((F.pow(m["n"] / (m["n"] + tau), F.lit(power)) / (D.entropy_bits(D.from_counts(m)) + 1e-6)).alias("w"), D.from_counts(m).alias("d")))
    return F.when(F.size(_up_to(k)) > 0, _normalised(parts)).otherwise(_fall_back())


def _normalised(parts: Column) -> Column:
    """Mixture with the weights brought to one: an array of one element binds the parts so they are computed once."""

    def mixed(held: Column) -> Column:
        whole = D.total(held, lambda x: x["w"])
        return D.mix(F.transform(held, lambda x: F.struct((x["w"] / whole).alias("w"), x["d"].alias("d"))))

    return F.get(F.transform(F.array(parts), mixed), F.lit(0))


def all_k(k: int, smoothing: float = 1e-3, least: int = 3, share: float = 0.4) -> Column:
    """All orders with at least `least` counts, smoothed and weighted by order, mixed with the first order."""
    size = F.col("size")
    use = F.filter(_up_to(k), lambda m: m["n"] >= least)

    def smooth(m: Column) -> Column:
        return D.from_counts(m, lambda c, n: (c + smoothing) / (n + smoothing * size), smoothing / (m["n"] + smoothing * size))

    parts = F.transform(use, lambda m: F.struct(m["k"].cast("double").alias("w"), smooth(m).alias("d")))
    return F.when(F.size(use) > 0, D.mix2(share, _normalised(parts), F.col("mc1"))).otherwise(F.col("mc1"))


def noise_filtered(k: int = 5, least: int = 2, share: float = 0.5) -> Column:
    """The longest context with a successor seen at least `least` times, those successors only, mixed with order one."""
    cleaned = F.transform(_up_to(k), lambda m: F.struct(m["k"].alias("k"), F.filter(m["nexts"], lambda x: x["cnt"] >= least).alias("nexts")))
    use = F.filter(cleaned, lambda m: F.size(m["nexts"]) > 0)

    def chosen(m: Column) -> Column:
        return D.from_counts(F.struct(D.total(m["nexts"], lambda x: x["cnt"]).alias("n"), m["nexts"].alias("nexts")))

    return F.when(F.size(use) > 0, D.mix2(share, F.get(F.transform(F.slice(use, F.greatest(F.size(use), F.lit(1)), F.lit(1)), chosen), F.lit(0)), F.col("mc1"))).otherwise(F.col("mc1"))


def multi_order(k: int, least: int = 3, share: float = 0.4) -> Column:
    """On ramp-up counts: the longest order that has enough counts, smoothed by 1 / size; order one is mixed."""
    size = F.col("size")
    alpha = 1.0 / size
    use = F.filter(_up_to(k), lambda m: (m["k"] == 1) | (m["n"] >= least))

    def smooth(m: Column) -> Column:
        return D.from_counts(m, lambda c, n: (c + alpha) / (n + alpha * size), alpha / (m["n"] + alpha * size))

    last = F.element_at(use, -1)
    return F.when(F.size(use) == 0, F.col("mc1")).when(last["k"] == 1, D.mix2(share, smooth(last), F.col("mc1"))).otherwise(smooth(last))


def prepare_rampup(train: DataFrame, contexts: DataFrame, highest: int) -> DataFrame:
    """As `prepare`, with ramp-up counts in `found` and plain first-order counts in mc1."""
    return with_rampup(prepare(train, contexts, 1), W.rampup(train, highest)[1], highest)


def with_rampup(prepared: DataFrame, moves: DataFrame, highest: int) -> DataFrame:
    """Prepared contexts with ramp-up counts (k, ctx, next, cnt) in `found`."""
    base = prepared.select("ctx", "size", "uni", "mc1")
    return W.match(base.select("ctx"), W.rows_of(moves), highest).join(base, "ctx")


def interpolate(share: float, d: Column, first: Column) -> Column:
    return D.mix2(share, d, first)


# population and individual memory


def _evidence_mix(parts: Column, tau: float) -> Column:
    """parts (k, n, d, h): weights (n / (n + tau)) / (h + 1e-8); if they vanish, inverse entropy alone."""

    def mixed(held: Column) -> Column:
        raw = D.total(held, lambda x: x["n"] / (x["n"] + tau) / (x["h"] + 1e-8))
        plain = D.total(held, lambda x: 1 / (x["h"] + 1e-8))
        return D.mix(
            F.transform(
                held,
                lambda x: F.struct(
                    F.when(raw > 1e-8, x["n"] / (x["n"] + tau) / (x["h"] + 1e-8) / raw).otherwise(1 / (x["h"] + 1e-8) / plain).alias("w"), x["d"].alias("d")
                ),
            )
        )

    return F.get(F.transform(F.array(parts), mixed), F.lit(0))


def population(train: DataFrame, contexts: DataFrame, length: int, highest: int, smoothing: float = 1e-4, first_order: str = "pre", tau: float = 8.0) -> DataFrame:
    """ctx, size, pop: the population memory over overlap-weighted counts.

    Order one is smoothed before (`pre`: (c + s) / (n + s size)) or after dividing (`post`: (c / n + s) / (1 + s size));
    higher orders are raw; an order without a row repeats order one with no evidence. Orders end at
    min(highest, length - 1), as windows of `length` nodes hold no longer ones.
    """
    top = max(1, min(highest, length - 1))
    return population_counts(W.overlap_ngrams(train, length, top), sizes(train), contexts, top, smoothing, first_order, tau)


def population_counts(counts: DataFrame, size_: DataFrame, contexts: DataFrame, top: int, smoothing: float = 1e-4, first_order: str = "pre", tau: float = 8.0) -> DataFrame:
    """`population` from overlap-weighted counts of orders 1 to `top` and one row with the size of the vocabulary; with
    counts of order one alone it is the smoothed first order."""
    found = _with_constants(W.match(contexts.select("ctx").distinct(), W.rows_of(counts), top), size_.withColumn("_one", F.lit(0)))
    size = F.col("size").cast("double")
    s = smoothing

    def order_one(m: Column) -> Column:
        if first_order == "pre":
            return D.from_counts(m, lambda c, n: (c + s) / (n + s * size), s / (m["n"] + s * size))
        return D.from_counts(m, lambda c, n: (c / n + s) / (1 + s * size), s / (1 + s * size))

    ones = F.filter("found", lambda m: m["k"] == 1)
    base = F.when(F.size(ones) > 0, order_one(F.get(ones, F.lit(0)))).otherwise(D.empty(1 / size))
    found = found.withColumn("_base", base).withColumn("_n1", F.coalesce(F.get(ones, F.lit(0))["n"], F.lit(0)).cast("double"))

    def part(k: Column) -> Column:
        own = F.filter("found", lambda m: m["k"] == k)
        has = F.size(own) > 0
        d = F.when((k == 1) | ~has, F.col("_base")).otherwise(D.from_counts(F.get(own, F.lit(0))))
        n = F.when(k == 1, F.col("_n1")).when(has, F.get(own, F.lit(0))["n"].cast("double")).otherwise(F.lit(0.0))
        return F.struct(k.alias("k"), n.alias("n"), d.alias("d"))

    orders = F.sequence(F.lit(1), F.least(F.lit(top), F.size("ctx")))
    parts = F.transform(F.transform(orders, part), lambda x: F.struct(x["k"], x["n"], x["d"], D.entropy_nats(x["d"], size).alias("h")))
    return found.withColumn("_parts", parts).select("ctx", "size", _evidence_mix(F.col("_parts"), tau).alias("pop"))


def individual(own: DataFrame, contexts: DataFrame, user: str, sizes: DataFrame, highest: int, tau: float = 8.0) -> DataFrame:
    """user, ctx, ind, n (matches of all orders), kmax: the individual memory over each user's own n-grams.

    p = (c + 1 / size) / (n + 1); an order without matches is uniform and has no evidence. `sizes` is one row (size).
    """
    found = W.match(contexts.select(user, "ctx").distinct(), W.rows_of(own, [user]), highest, [user])
    found = found.withColumn("_one", F.lit(0)).join(F.broadcast(sizes.withColumn("_one", F.lit(0))), "_one").drop("_one")
    size = F.col("size").cast("double")

    def part(k: Column) -> Column:
        m = F.get(F.filter("found", lambda x: x["k"] == k), F.lit(0))
        d = F.when(m.isNotNull(), D.from_counts(m, lambda c, n: (c + 1 / size) / (n + 1), 1 / size / (m["n"] + 1))).otherwise(D.empty(1 / size))
        return F.struct(F.coalesce(m["n"], F.lit(0)).cast("double").alias("n"), d.alias("d"))

    orders = F.sequence(F.lit(1), F.least(F.lit(highest), F.size("ctx")))
    parts = F.transform(F.transform(orders, part), lambda x: F.struct(x["n"], x["d"], D.entropy_nats(x["d"], size).alias("h")))
    found = found.withColumn("_parts", parts)
    return found.select(
        user, "ctx", _evidence_mix(F.col("_parts"), tau).alias("ind"), D.total(F.col("found"), lambda m: m["n"]).alias("n"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["k"])), F.lit(0)).alias("kmax"),
    )


def gate(pop: DataFrame, ind: DataFrame, highest: int, boost: float = 5.0, prior: float = 5.0) -> DataFrame:
    """user, ctx, size, pop, ind, conf, a_pop, a_ind, mixed: both memories weighted by inverse entropy, the individual
    one also by its support: conf = n / (n + prior) * kmax / highest * sqrt(highest p). `shown_ind` is the weight
    without the order and peak factors, which explanations report."""
    both = ind.join(pop, "ctx")
    size = F.col("size").cast("double")
    peak = F.greatest(F.array_max(F.transform("ind.p", lambda x: x["p"])), F.col("ind.floor"))
    conf = F.col("n") / (F.col("n") + prior) * F.col("kmax") / highest * F.sqrt(F.coalesce(peak, F.col("ind.floor")))
    both = both.withColumn("conf", conf).withColumn("h_pop", D.entropy_nats(F.col("pop"), size)).withColumn("h_ind", D.entropy_nats(F.col("ind"), size))
    w_pop = 1 / (F.col("h_pop") + 1e-8)
    w_ind = (1 + boost * F.col("conf")) / (F.col("h_ind") + 1e-8)
    shown = (1 + boost * F.col("n") / (F.col("n") + prior)) / (F.col("h_ind") + 1e-8)
    both = both.withColumn("a_ind", w_ind / (w_ind + w_pop)).withColumn("a_pop", w_pop / (w_ind + w_pop)).withColumn("shown_ind", shown / (shown + w_pop))
    return both.withColumn("mixed", D.mix2(F.col("a_ind"), F.col("ind"), F.col("pop")))


# topology


def neighbours_uniform(contexts: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """ctx and the uniform distribution over the successors of its last node, over all nodes if it has none."""
    last = contexts.select("ctx", F.element_at("ctx", -1).alias("source")).distinct()
    out = edges.select("source", "target").where("source <> target").distinct().groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("to"))
    n = F.size("to")
    d = F.struct(F.transform("to", lambda v: F.struct(v.alias("node"), (1.0 / n).alias("p"))).alias("p"), F.lit(0.0).alias("floor"))
    return last.join(out, "source", "left").select("ctx", F.when(n > 0, d).otherwise(D.empty(F.lit(1.0 / size))).alias("d"))


def _held(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def masked(d: Column, to: Column, size: Column) -> Column:
    """d on the successors alone, brought to one; d itself if they hold no mass."""
    kept = F.struct(F.filter(d["p"], lambda x: F.array_contains(to, x["node"])).alias("p"), F.lit(0.0).alias("floor"))
    rest = F.transform(F.array_except(to, F.transform(d["p"], lambda x: x["node"])), lambda v: F.struct(v.alias("node"), d["floor"].alias("p")))
    whole = F.struct(F.concat(kept["p"], rest).alias("p"), F.lit(0.0).alias("floor"))

    def judged(k: Column) -> Column:
        mass = D.total(k["p"], lambda x: x["p"])
        return F.when(mass > 0, D.scaled(k, mass)).otherwise(d)

    return F.when(F.coalesce(F.size(to), F.lit(0)) > 0, _held(whole, judged)).otherwise(d)


def with_prior(d: Column, to: Column, size: Column, beta: float) -> Column:
    """d times (beta * share of the successors + (1 - beta) / size), brought to one."""
    base = (1 - beta) / size
    n = F.coalesce(F.size(to), F.lit(0))
    rest = F.transform(F.array_except(to, F.transform(d["p"], lambda x: x["node"])), lambda v: F.struct(v.alias("node"), d["floor"].alias("p")))

    def lifted(x: Column) -> Column:
        return F.struct(x["node"].alias("node"), (x["p"] * (base + F.when(F.array_contains(to, x["node"]), beta / n).otherwise(F.lit(0.0)))).alias("p"))

    raw = F.struct(F.transform(F.concat(d["p"], rest), lifted).alias("p"), (d["floor"] * base).alias("floor"))

    def judged(r: Column) -> Column:
        mass = D.mass(r, size)
        return F.when(mass > 0, D.scaled(r, mass)).otherwise(d)

    return F.when(n > 0, _held(raw, judged)).otherwise(d)
