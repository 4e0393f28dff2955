"""The registered queries of feature selection, and the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siftwright.functions.expressions import bin_of, bin_sql, seeded_order
from siftwright.functions.shared import fresh_path, stored
from siftwright.operators import counts as C, evaluate, information as I, logistic, pairs, prep, select, sites, telemetry
from siftwright.operators.neighbours import nearest
from siftwright.sources import files
from siftwright.sources.views import CLIENTS, EMB_SQL, LI_FEATURES, LI_SQL, embeddings as emb, lineitem, table
from siftwright.streaming import replay, rollups, rounds, tables

BINS, K, RATIO = 5, 5, 0.3
#: The shards' clients and the blocks' shares of rows in the queries over unlike sites.
OWNERS, SHARES = (0, 1, 2, 3, 3, 2, 1, 0), (0.1, 0.2, 0.3)
#: Sizes of a client's table.
SHAPE = {"feature": len(LI_FEATURES), "bin": BINS}
PICKED, IDEAL, FOUND = (34, 29, 0), (0, 1, 2, 3), (2, 3, 4)


def li(spark, d):
    return prep.relabel(lineitem(spark, d))


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def emb_bins(spark, d):
    return prep.discretize(emb(spark, d), BINS)


def long_bins(rows, *ids):
    return rows.select(*ids, F.posexplode("bins").alias("feature", "bin"))


def subjects(spark, d):
    return emb(spark, d).withColumn("subject", F.col("row_id") % 3 * 2 + 1)


def dirty(spark, d):
    """Lines with a sentinel for some values, and the line status as subject."""
    x = [F.when(F.col("l_quantity") <= 30, -1.0).otherwise(F.col("l_quantity")), F.col("l_extendedprice"), F.col("l_discount"), F.when(F.col("l_tax") == 0, -1.0).otherwise(F.col("l_tax")), F.col("l_linenumber").cast("double")]
    return prep.sentinel_to_null(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("subject"), F.array(*x).alias("features")))


def holed(spark, d):
    """Vectors whose negative values are missing."""
    return emb(spark, d).withColumn("features", F.transform("features", lambda x: F.when(x >= 0, x)))


def src_matrix_text(spark, d):
    """The matrix as text, in row order, read back and aligned by line."""
    path = fresh_path(spark, "matrix")
    files.write_matrix_text(emb(spark, d), f"{path}/data", f"{path}/labels")
    back = files.read_matrix(spark, f"{path}/data", f"{path}/labels")
    return back.select("row_id", "y", F.posexplode("features").alias("feature", "x")).groupBy("row_id", "y").agg(F.round(F.sum("x"), 6).alias("total"), F.count("*").alias("width"))


def src_union_splits(spark, d):
    rows = emb(spark, d).select("row_id", "y")
    return files.stacked(("train", rows.filter("row_id % 5 <> 0")), ("valid", rows.filter("row_id % 5 = 0")))


def src_sensor_logs(spark, d):
    """Logs of three subjects: time, the vector as sensors (negative values missing) and the label,
    written and read back as text; features by position, the subject from the file's name."""
    path = fresh_path(spark, "sensors")
    values = F.concat(F.array(F.col("row_id").cast("double")), F.transform("features", lambda x: F.when(x >= 0, x)), F.array(F.col("y").cast("double")))
    files.write_sensor_logs(emb(spark, d).select((F.col("row_id") % 3 + 1).alias("subject"), F.col("row_id").alias("line"), values.alias("values")), path)
    logs = files.read_sensor_logs(spark, f"{path}/S*-*.dat")
    rows = prep.drop_null_class(prep.sentinel_to_null(prep.sensor_columns(logs, 1, 64, 65)))
    long = rows.select("subject", F.posexplode("features").alias("feature", "x"))
    return long.groupBy("subject", "feature").agg(F.count("*").alias("n"), F.count("x").alias("present"), F.round(F.sum("x"), 4).alias("total"))


def src_selected_read(spark, d):
    path = fresh_path(spark, "selection")
    files.write_selection(select.mim(emb_bins(spark, d), K, BINS), path)
    return files.read_selection(spark, path)


def sink_client_parts(spark, d):
    path = fresh_path(spark, "clients")
    files.write_by_client(emb(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("client").cast("long").alias("client")).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


def cleaned(spark, d):
    """(kept features, rows): values missing, rows without class dropped, sparse features dropped,
    medians filled in."""
    rows = prep.drop_null_class(emb(spark, d).withColumn("subject", F.col("row_id") % 3).withColumn("features", F.transform("features", lambda x, i: F.when((x < 0) & (i % 2 == 0), None).when((x < 0.05) & (i % 2 == 1), None).otherwise(x))))
    kept = prep.kept_features(rows)
    return kept, prep.impute_median(prep.project(rows, kept))


def sink_cleaned(spark, d):
    """The cleaned matrix with its labels and subjects, written and read back."""
    path = fresh_path(spark, "cleaned")
    files.write_cleaned(cleaned(spark, d)[1], path)
    back = files.read_cleaned(spark, path)
    return back.groupBy("subject", "y").agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), F.round(F.sum(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)), 4).alias("total"))


def prep_clean_pipeline(spark, d):
    kept, out = cleaned(spark, d)
    numbers = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<int>")
    return out.select("row_id", "y", F.posexplode("features").alias("i", "x")).select("row_id", "y", F.get(numbers, F.col("i")).alias("feature"), F.round("x", 6).alias("x"))


def given_ranges(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("feature"), F.lit(-0.1).alias("mn"), F.lit(0.1).alias("mx"))


def site_probs(spark, d):
    rows = li(spark, d)
    return C.probabilities(C.joint_counts(rows, "client", bins=BINS), rows)


def mi_pair(spark, d):
    rows = emb_bins(spark, d)
    return I.mutual_information(I.shares(C.pair_counts(rows, 0, bins=BINS), "k", "j"), ("k", "j"), ("bin_k", "bin_j")).select("k", "j", *_r("mi"))


def site_pair_probs(spark, d):
    rows = li(spark, d)
    return C.probabilities(C.pair_counts(rows, 0, "client", bins=BINS), rows).select("client", "k", "j", "bin_k", "bin_j", "y", *_r("p"))


def gapped(spark, d):
    """Counts whose bins have gaps: the second of five bins is moved into the first."""
    return C.joint_counts(emb_bins(spark, d).withColumn("bins", F.transform("bins", lambda b: F.when(b == 1, 0).otherwise(b))), bins=BINS)


def split_rows(spark, d):
    return evaluate.split(emb(spark, d), RATIO)


def bayes(spark, d):
    return evaluate.gaussian_bayes(split_rows(spark, d))


def neighbours(spark, d):
    return evaluate.nearest_neighbours(split_rows(spark, d))


def eval_knn_nearest(spark, d):
    """The five nearest training rows of each test row, with their squared distances."""
    rows = split_rows(spark, d)
    best, _ = nearest(rows.filter("is_test"), rows.filter("NOT is_test"))
    return best.select("row_id", "near", "label", *_r("d"))


def eval_lr_gradient(spark, d):
    """The slope of each label's sum of losses at the weights found, which is 0 at the least."""
    train = stored(evaluate.scale(split_rows(spark, d)).filter("NOT is_test"), "train")
    return logistic.gradients(train, *logistic.fit(train)).select("label", F.round("slope", 2).alias("slope"))


def eval_confusion(spark, d):
    return evaluate.confusion(neighbours(spark, d), emb(spark, d))


def of_events(rows):
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), F.col("event_type").alias("phase"), F.col("value").alias("seconds"), "props")


def reports(spark, d):
    return of_events(table(spark, d, "events"))


def energy(rows):
    """Purchases as reports of energy, with the number in their properties as hundredths of CO2."""
    return rollups.parsed(rows.filter("phase = 'purchase'").withColumnRenamed("seconds", "kwh"), "k INT").withColumn("co2_kg", F.col("k") / 100)


def records(spark, d):
    """A client's day as a record of phases; one without clicks or purchases lacks a time that it needs."""
    rows = reports(spark, d).withColumn("day", F.to_date("ts"))
    of = lambda phase: F.sum(F.when(F.col("phase") == phase, F.col("seconds")))
    return rows.groupBy("client", "day").agg(of("signup").alias("load"), of("view").alias("pre"), of("click").alias("compute"), of("purchase").alias("comm"))


def telemetry_profile(spark, d):
    rows = reports(spark, d)
    server = rows.filter("phase = 'error'").select(F.when(F.col("id") % 2 == 0, "agg").otherwise("mi").alias("phase"), "seconds")
    span = rows.agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("span"))
    return telemetry.profile(records(spark, d), server, span).select(*_r("load", "pre", "compute", "comm", "agg", "mi", "total", "others"))


def json_messages(spark, d):
    """Events as JSON messages and back."""
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), F.col("user_id").alias("client"))
    back = rollups.parsed(rollups.as_messages(rows, "id", "client").withColumn("chars", F.length("props")), "id LONG, client LONG")
    return back.groupBy("event_type").agg(F.count("id").alias("n"), F.sum("id").alias("ids"), F.sum("client").alias("clients"), F.sum("chars").alias("chars"))


def combine_valid(spark, d):
    """Client 1 sends a cell that the table does not have, client 2 a negative number of rows."""
    probs = site_probs(spark, d)
    bad = probs.withColumn("bin", F.when((F.col("client") == 1) & (F.col("feature") == 0), F.col("bin") + BINS).otherwise(F.col("bin"))).withColumn("n", F.when(F.col("client") == 2, -F.col("n")).otherwise(F.col("n")))
    return C.combine(bad, CLIENTS, shape=SHAPE).select("feature", "bin", "y", *_r("p"))


def select_jmi_incomplete(spark, d):
    """Client 1 has no values of the odd features, so no pair with them is complete."""
    rows = emb_bins(spark, d).withColumn("bins", F.transform("bins", lambda b, i: F.when((F.col("client") != 1) | (i % 2 == 0), b)))
    return select.jmi(rows, 3, BINS, "simple").select("rank", "feature", *_r("score"))


def streamed_reports(spark, d):
    return of_events(rollups.stream_of(spark, d, "events"))


def streamed_counts(spark, d):
    rows = rollups.stream_of(spark, d, "lineitem").select((F.col("l_suppkey") % CLIENTS).alias("client"), F.col("l_returnflag").alias("y"), F.array(F.col("l_quantity"), F.col("l_discount")).alias("features"))
    bounds = ((1.0, 50.0), (0.0, 0.1))
    binned = rows.withColumn("bins", F.array(*[bin_of(F.get("features", F.lit(i)), F.lit(a), F.lit(b), BINS) for i, (a, b) in enumerate(bounds)]))
    return rollups.running_counts(binned)


def stream_joint_counts(spark, d):
    return rollups.drained(streamed_counts(spark, d), "client", "feature", "bin", "y").select("client", "feature", "bin", "y", "c")


def stream_information(spark, d):
    """Information per feature, worked out again from the running counts at each batch."""
    return rollups.drained(streamed_counts(spark, d), "client", "feature", "bin", "y", then=rollups.refreshed_information).select("feature", *_r("mi"))


def stream_first_reports(spark, d):
    """Rounds by kind of event; complete once every known client has reported."""
    clients = table(spark, d, "events").select(F.col("user_id").alias("client")).filter("client IS NOT NULL").distinct()
    rows = streamed_reports(spark, d).withColumnRenamed("phase", "round")
    first = rollups.drained(rollups.first_reports(rows, clients, "seconds"), "client", "round")
    totals = first.groupBy("round").agg(F.sum("id").alias("ids"), F.round(F.sum("seconds"), 4).alias("seconds"))
    return rollups.complete_rounds(first, clients.count()).join(totals, "round")


def stream_json(spark, d):
    """The sum of a JSON message's number by kind of event."""
    rows = rollups.parsed(rollups.stream_of(spark, d, "events").select("event_type", "props"), "k INT")
    return rollups.drained(rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total")), "event_type")


def stream_phase_times(spark, d):
    return telemetry.slowest(rollups.drained(telemetry.client_phases(streamed_reports(spark, d)), "client", "phase")).select("phase", *_r("seconds"))


def stream_energy(spark, d):
    return telemetry.total_energy(rollups.drained(telemetry.last_energy(energy(streamed_reports(spark, d))), "client")).select("clients", *_r("kwh", "co2_kg"))


def arriving(rows, *lags):
    """Adds the batch of six days in which a message arrives: by its day, and days more for some ids,
    ``(every, days)`` each."""
    more = F.lit(0)
    for every, days in lags:
        more = F.when(F.col("id") % every == 0, days).otherwise(more)
    day = F.floor(F.unix_micros("ts") / 86400000000)
    return rows.withColumn("batch", F.floor((day + more) / 6))


def report_messages(spark, d):
    """A client's reports in a round, a day: one for each batch that brings some, in disorder; some are
    sent twice, some again with the next batch."""
    rows = reports(spark, d).filter("client IS NOT NULL AND ts IS NOT NULL").withColumn("round", F.floor(F.unix_micros("ts") / 86400000000))
    once = arriving(rows, (3, 1), (11, 6)).groupBy("round", "client", "batch").agg(F.min(F.struct("ts", "id", "seconds")).alias("m")).select("round", "client", "batch", "m.*")
    return once.unionByName(once.filter("id % 5 = 0")).unionByName(once.filter("id % 7 = 0").withColumn("batch", F.col("batch") + 1))


def stream_late_reports(spark, d):
    """First reports of known clients under a watermark of a day: by round, and the rows that were late."""
    clients = spark.range(1000).select(F.col("id").alias("client")).filter("client % 10 <> 9")
    first = replay.Changes(spark, fresh_path(spark, "first"), "round", "client")
    progress = replay.replayed(report_messages(spark, d), lambda stream: rounds.first_reports(stream, clients, "1 day"), first.write, "append")
    late = F.lit(replay.late_rows(progress)).cast("long").alias("late")
    return first.state().groupBy("round").agg(F.count("*").alias("clients"), F.sum("id").alias("ids"), F.round(F.sum("seconds"), 4).alias("seconds"), late)


HOUR, LIMIT, EXPECTED = 3600000, 2700000, (0, 1, 2, 3, 4, 5)


def stream_closed_rounds(spark, d):
    """Rounds of an hour that close with the last of six clients or after 45 minutes; each message
    brings the pairs that its client could count."""
    rows = reports(spark, d).filter("client IS NOT NULL AND ts IS NOT NULL AND phase IN ('view', 'click')")
    rows = rows.select("id", "ts", F.floor(F.unix_micros("ts") / (HOUR * 1000)).alias("round"), (F.col("client") % 8).alias("client"), F.filter(F.array(*map(F.lit, range(4))), lambda p: (F.col("id") + p) % 9 != 0).alias("pairs"))
    closed = replay.Changes(spark, fresh_path(spark, "closed"), "round")
    replay.replayed(arriving(rows, (4, 1), (13, 7)), lambda stream: rounds.closed_rounds(stream, list(EXPECTED), HOUR, LIMIT, "2 hours"), closed.write, "append", store=rounds.STORE)
    return closed.state().select("round", "complete", "clients", F.array_join(F.transform("excluded", lambda p: p.cast("string")), ",").alias("excluded"))


def binned_lines(rows, *more):
    """Quantity and discount in bins of given ranges, with the client and the return flag."""
    bounds = (("l_quantity", 1.0, 50.0), ("l_discount", 0.0, 0.1))
    return rows.select((F.col("l_suppkey") % CLIENTS).alias("client"), F.col("l_returnflag").alias("y"), F.array(*[bin_of(F.col(c), F.lit(a), F.lit(b), BINS) for c, a, b in bounds]).alias("bins"), *more)


def stream_count_store(spark, d):
    """Information from a store of counts that lines reach in three batches, the first of them twice;
    then client 3 withdraws, and client 2 sends its lines of a quantity up to 30 instead of all."""
    lines = table(spark, d, "lineitem")
    store = tables.CountStore(spark, fresh_path(spark, "counts"))

    def take(batch, number):
        store.add(f"batch-{number}", batch)
        store.add("batch-0", batch)

    replay.replayed(binned_lines(lines, (F.col("l_orderkey") % 3).alias("batch")), lambda stream: stream, take, "append")
    store.withdraw("client 3 leaves", 3)
    store.replace("client 2 again", 2, binned_lines(lines.filter("l_quantity <= 30")))
    return store.information().select("feature", *_r("mi"))


def block_sizes(n):
    sizes = [int(n * s) for s in SHARES]
    return [*sizes, n - sum(sizes)]


def features_of(spark, d):
    return emb(spark, d).select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)).alias("feature")).distinct()


def named(spark, d, features):
    return features_of(spark, d).filter(F.col("feature").isin(*features))


QUERIES = {
    "select_mim_pooled": lambda s, d: select.mim(emb_bins(s, d), K, BINS).select("rank", "feature", *_r("score")),
    "src_matrix_text": src_matrix_text,
    "src_union_splits": src_union_splits,
    "src_sensor_logs": src_sensor_logs,
    "sink_cleaned": sink_cleaned,
    "src_selected_read": src_selected_read,
    "sink_client_parts": sink_client_parts,
    "prep_label_nonneg": lambda s, d: prep.nonnegative_label(emb(s, d).withColumn("y", F.col("y") - 3)).select("row_id", "y"),
    "prep_relabel": lambda s, d: prep.relabel(emb(s, d).withColumn("y", F.col("y") * 7 - 9)).select("row_id", "y"),
    "prep_sentinel_null": lambda s, d: dirty(s, d).select("subject", F.posexplode("features").alias("feature", "x")).groupBy("subject", "feature").agg(F.count("*").alias("n"), F.count("x").alias("present")),
    "prep_drop_null_class": lambda s, d: prep.drop_null_class(emb(s, d)).select("row_id", "y"),
    "prep_every_nth": lambda s, d: prep.every_nth(emb(s, d), 3, "client", "row_id").select("client", "row_id"),
    "prep_null_fraction": lambda s, d: prep.null_fractions(dirty(s, d)).select("subject", "feature", *_r("fraction")),
    "prep_drop_sparse": lambda s, d: prep.worst_fractions(dirty(s, d)).select("feature", (F.col("worst") <= 0.5).alias("kept")),
    "prep_impute_median": lambda s, d: prep.impute_median(holed(s, d)).select("row_id", F.posexplode("features").alias("feature", "x")).select("row_id", "feature", *_r("x")),
    "prep_clean_pipeline": prep_clean_pipeline,
    "select_project_features": lambda s, d: prep.project(emb(s, d), list(PICKED)).select("row_id", F.posexplode("features").alias("place", "x")).select("row_id", "place", *_r("x")),
    "disc_equalwidth": lambda s, d: long_bins(emb_bins(s, d), "row_id"),
    "disc_given_ranges": lambda s, d: long_bins(prep.discretize(emb(s, d), BINS, given_ranges(s)), "row_id"),
    "site_assign_join": lambda s, d: sites.assigned(emb(s, d), emb(s, d).select("row_id", (F.col("row_id") % 3).alias("client"))).groupBy("client").agg(F.count("*").alias("n"), F.sum("y").alias("total")),
    "jmi_pair_counts": lambda s, d: C.pair_counts(emb_bins(s, d), 0, bins=BINS),
    "tpr_overlap": lambda s, d: select.agreement(named(s, d, IDEAL), named(s, d, FOUND)),
    "jmi_candidates": lambda s, d: select.candidates(features_of(s, d), named(s, d, PICKED)),
    "site_label_dispersion": lambda s, d: sites.dispersion(emb(s, d)),
    "site_extremes": lambda s, d: prep.extremes(li(s, d), "client"),
    "global_ranges": lambda s, d: prep.global_ranges(prep.extremes(li(s, d), "client")),
    "label_arity": lambda s, d: prep.label_arity(li(s, d)),
    "joint_counts": lambda s, d: C.joint_counts(li(s, d), bins=BINS),
    "joint_counts_blocks": lambda s, d: C.joint_counts(emb_bins(s, d), "client", bins=BINS, blocks=True),
    "joint_counts_raw_blocks": lambda s, d: C.joint_counts(emb(s, d), "client", bins=BINS, blocks=True),
    "mi_all_pairs": lambda s, d: pairs.information_matrix(emb_bins(s, d), 64, BINS).select("k", "j", *_r("mi")),
    "mi_all_pairs_sites": lambda s, d: pairs.information_matrix(emb_bins(s, d), 64, BINS, "weighted").select("k", "j", *_r("mi")),
    "site_joint_probs": lambda s, d: site_probs(s, d).select("client", "feature", "bin", "y", *_r("p")),
    "site_pair_probs": site_pair_probs,
    "combine_simple": lambda s, d: C.combine(site_probs(s, d), CLIENTS, shape=SHAPE).select("feature", "bin", "y", *_r("p")),
    "combine_weighted": lambda s, d: C.combine(site_probs(s, d), CLIENTS, True, SHAPE).select("feature", "bin", "y", *_r("p")),
    "mi_feature_bits": lambda s, d: I.mutual_information(I.shares(C.joint_counts(emb_bins(s, d), bins=BINS), "feature")).select("feature", *_r("mi")),
    "mi_feature_nats": lambda s, d: I.mutual_information(I.shares(C.joint_counts(li(s, d), bins=BINS), "feature"), nats=True).select("feature", *_r("mi")),
    "mi_pair_bits": mi_pair,
    "mi_gap_merge": lambda s, d: I.mutual_information(I.shares(I.merge_gaps(gapped(s, d)), "feature"), nats=True).select("feature", *_r("mi")),
    "select_mim_sites": lambda s, d: select.mim(emb_bins(s, d), K, BINS, "simple").select("rank", "feature", *_r("score")),
    "select_jmi_pooled": lambda s, d: select.jmi(emb_bins(s, d), 3, BINS).select("rank", "feature", *_r("score")),
    "select_jmi_sites": lambda s, d: select.jmi(emb_bins(s, d), 3, BINS, "simple").select("rank", "feature", *_r("score")),
    "site_iid": lambda s, d: sites.iid(emb(s, d).drop("client"), 3).select("row_id", "client"),
    "site_noniid_shards": lambda s, d: sites.label_shards(emb(s, d).drop("client"), CLIENTS, list(OWNERS)).select("row_id", "client"),
    "site_noniid_uneven": lambda s, d: sites.label_blocks(emb(s, d).drop("client"), block_sizes(emb(s, d).count())).select("row_id", "client"),
    "site_by_subject": lambda s, d: sites.by_subject(subjects(s, d).drop("client")).select("row_id", "client"),
    "eval_split": lambda s, d: split_rows(s, d).select("row_id", "is_test"),
    "eval_split_stratified": lambda s, d: evaluate.split(emb(s, d), RATIO, stratified=True).select("row_id", "is_test"),
    "eval_scale": lambda s, d: evaluate.scale(split_rows(s, d)).select("row_id", F.posexplode("features").alias("feature", "x")).select("row_id", "feature", *_r("x")),
    "eval_gnb": bayes,
    "eval_knn": neighbours,
    "eval_knn_nearest": eval_knn_nearest,
    "eval_confusion": eval_confusion,
    "eval_class_report": lambda s, d: evaluate.class_report(eval_confusion(s, d)).select("label", *_r("precision", "recall", "f1"), "support"),
    "eval_accuracy_micro": lambda s, d: evaluate.accuracy_micro(bayes(s, d)).select(*_r("accuracy", "precision_micro", "recall_micro", "f1_micro")),
    "eval_iterations": lambda s, d: evaluate.iterate(emb(s, d), "gnb", 2, RATIO).select("iterations", *_r("mean_accuracy", "std_accuracy")),
    "eval_loop_gnb": lambda s, d: evaluate.loop(emb(s, d), "gnb", 2, RATIO, features=list(PICKED)).select("iteration", *_r("accuracy", "precision_micro", "recall_micro", "f1_micro")),
    "eval_rf": lambda s, d: evaluate.random_forest(split_rows(s, d)),
    "eval_lr_gradient": eval_lr_gradient,
    "eval_lr": lambda s, d: evaluate.logistic_regression(evaluate.scale(split_rows(s, d))),
    "telemetry_phase_times": lambda s, d: telemetry.slowest(telemetry.client_phases(reports(s, d))).select("phase", *_r("seconds")),
    "telemetry_records": lambda s, d: telemetry.client_records(records(s, d)).select(F.col("client").cast("long").alias("client"), *_r("load", "pre", "compute", "comm")),
    "telemetry_profile": telemetry_profile,
    "json_messages": json_messages,
    "combine_fallback": lambda s, d: C.combine(site_probs(s, d).withColumn("n", F.lit(0)), CLIENTS, True, SHAPE).select("feature", "bin", "y", *_r("p")),
    "combine_valid": combine_valid,
    "select_jmi_incomplete": select_jmi_incomplete,
    "telemetry_energy": lambda s, d: telemetry.total_energy(telemetry.last_energy(energy(reports(s, d)))).select("clients", *_r("kwh", "co2_kg")),
    "stream_joint_counts": stream_joint_counts,
    "stream_information": stream_information,
    "stream_json": stream_json,
    "stream_first_reports": stream_first_reports,
    "stream_phase_times": stream_phase_times,
    "stream_energy": stream_energy,
    "stream_late_reports": stream_late_reports,
    "stream_closed_rounds": stream_closed_rounds,
    "stream_count_store": stream_count_store,
}


def _mi(src, unit="feature", x="bin", log="log2"):
    return f"""(SELECT {unit}, CASE WHEN sum(t) > 1e-12 THEN sum(t) ELSE 0.0 END AS mi FROM (
  SELECT *, CASE WHEN p > 1e-12 AND px > 1e-12 AND py > 1e-12 THEN p * {log}(p / (px * py)) ELSE 0.0 END AS t FROM (
  SELECT *, sum(p) OVER (PARTITION BY {unit}, {x}) AS px, sum(p) OVER (PARTITION BY {unit}, y) AS py FROM {src})) GROUP BY {unit})"""


def _d(base, ids):
    return f"{base}, rng AS (SELECT feature, min(x) AS mn, max(x) AS mx FROM el GROUP BY feature), d AS (SELECT {ids}, client, y, feature, {bin_sql('x', 'mn', 'mx', BINS)} AS bin FROM el JOIN rng USING (feature))"


EMB_D, LI_D = _d(EMB_SQL, "row_id"), _d(LI_SQL, "1 AS one")
_COUNTS = "c AS (SELECT feature, bin, y, count(*) AS c FROM d GROUP BY ALL), pc AS (SELECT *, c / sum(c) OVER (PARTITION BY feature) AS p FROM c)"
_SITE = "ns AS (SELECT client, count(*) / (SELECT count(DISTINCT feature) FROM d) AS n FROM d GROUP BY client), sp AS (SELECT client, feature, bin, y, count(*) / any_value(n) AS p, any_value(n) AS n FROM d JOIN ns USING (client) GROUP BY client, feature, bin, y)"
_PAIRS = "pr AS (SELECT a.feature AS k, b.feature AS j, a.bin AS bin_k, b.bin AS bin_j, a.y, count(*) AS c FROM d a JOIN d b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY ALL), pp AS (SELECT *, c / sum(c) OVER (PARTITION BY k, j) AS p FROM pr)"
_SITE_PAIRS = f"pr AS (SELECT a.client, a.feature AS k, b.feature AS j, a.bin AS bin_k, b.bin AS bin_j, a.y, count(*) AS c FROM d a JOIN d b ON a.row_id = b.row_id AND a.feature <> b.feature GROUP BY ALL), pp AS (SELECT k, j, bin_k, bin_j, y, sum(c / n) / {CLIENTS}.0 AS p FROM pr JOIN ns USING (client) GROUP BY ALL)"
_GREEDY = f"""pm AS {_mi('pp', 'k, j', 'bin_k, bin_j')},
s1 AS (SELECT feature, mi AS score FROM fm ORDER BY round(mi, 9) DESC, feature LIMIT 1),
s2 AS (SELECT k AS feature, mi AS score FROM pm JOIN s1 ON j = s1.feature ORDER BY round(mi, 9) DESC, k LIMIT 1),
s3 AS (SELECT k AS feature, sum(mi) AS score FROM pm WHERE j IN (SELECT feature FROM s1 UNION ALL SELECT feature FROM s2) AND k NOT IN (SELECT feature FROM s1 UNION ALL SELECT feature FROM s2) GROUP BY k ORDER BY round(sum(mi), 9) DESC, k LIMIT 1)
SELECT 1 AS rank, feature, round(score, 6) AS score FROM s1 UNION ALL SELECT 2, feature, round(score, 6) FROM s2 UNION ALL SELECT 3, feature, round(score, 6) FROM s3"""
_DIRTY = "dl AS (SELECT l_linestatus AS subject, unnest([0, 1, 2, 3, 4]) AS feature, unnest([CASE WHEN l_quantity > 30 THEN l_quantity END, l_extendedprice, l_discount, nullif(l_tax, 0), CAST(l_linenumber AS DOUBLE)]) AS x FROM lineitem), fr AS (SELECT subject, feature, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS fraction FROM dl GROUP BY ALL)"


def _split(seed=0, name="s"):
    return f"{name} AS (SELECT * EXCLUDE (place, n), place <= ceil(CAST({RATIO} AS DOUBLE) * n) AS is_test FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || row_id), row_id) AS place, count(*) OVER () AS n FROM emb))"


_S = f"{EMB_SQL}, {_split()}, sl AS (SELECT row_id, y, is_test, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM s)"
_STATS = "st AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM sl WHERE NOT is_test GROUP BY feature)"


def _gnb(src="sl", tail=""):
    return f"""mo{tail} AS (SELECT y, feature, avg(x) AS mu, var_pop(x) + 1e-9 * (SELECT max(v) FROM (SELECT var_pop(x) AS v FROM {src} WHERE NOT is_test GROUP BY feature)) AS v FROM {src} WHERE NOT is_test GROUP BY y, feature),
pi{tail} AS (SELECT y, ln(count(DISTINCT row_id) / (SELECT count(DISTINCT row_id) FROM {src} WHERE NOT is_test)) AS prior FROM {src} WHERE NOT is_test GROUP BY y),
sc{tail} AS (SELECT t.row_id, t.y, m.y AS c, any_value(prior) + sum(-0.5 * ln(2 * pi() * v) - (x - mu) * (x - mu) / (2 * v)) AS ll FROM {src} t JOIN mo{tail} m USING (feature) JOIN pi{tail} q ON q.y = m.y WHERE is_test GROUP BY t.row_id, t.y, m.y),
gp{tail} AS (SELECT row_id, any_value(y) AS y, arg_max(c, ll) AS pred FROM sc{tail} GROUP BY row_id)"""


_KNN = f"""{_S}, di AS (SELECT t.row_id, t.y, r.y AS label, row_number() OVER (PARTITION BY t.row_id ORDER BY list_distance(t.features, r.features), r.row_id) AS o FROM s t JOIN s r ON t.is_test AND NOT r.is_test),
vo AS (SELECT row_id, y, label, count(*) AS n FROM di WHERE o <= 5 GROUP BY ALL),
gp AS (SELECT row_id, y, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) AS o FROM vo) WHERE o = 1),
lab AS (SELECT DISTINCT y FROM emb), cm AS (SELECT a.y, b.y AS pred, count(gp.row_id) AS c FROM lab a CROSS JOIN lab b LEFT JOIN gp ON gp.y = a.y AND gp.pred = b.y GROUP BY ALL)"""
_REPORT = """pt AS (SELECT y AS l, sum(c) FILTER (WHERE y = pred) AS t, sum(c) AS s FROM cm GROUP BY y), pd AS (SELECT pred AS l, sum(c) AS p FROM cm GROUP BY pred),
e AS (SELECT CAST(l AS VARCHAR) AS label, coalesce(t / nullif(p, 0), 0) AS precision, coalesce(t / nullif(s, 0), 0) AS recall, CAST(s AS BIGINT) AS support FROM pt JOIN pd USING (l)),
f AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM e),
g AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM g"""


def _rounds(n, features="true"):
    """The tables of n iterations over some features, and a row (iteration, a: accuracy) of each."""
    parts, names = [EMB_SQL], []
    for i in range(n):
        parts.append(_split(i, f"s{i}"))
        parts.append(f"t{i} AS (SELECT row_id, y, is_test, unnest(range(0, len(features))) AS feature, unnest(features) AS x FROM s{i}), u{i} AS (SELECT * FROM t{i} WHERE {features}), w{i} AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM u{i} WHERE NOT is_test GROUP BY feature), v{i} AS (SELECT row_id, y, is_test, feature, (x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS x FROM u{i} JOIN w{i} USING (feature))")
        parts.append(_gnb(f"v{i}", str(i)))
        names.append(f"SELECT {i} AS iteration, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS a FROM gp{i}")
    return f"WITH {', '.join(parts)}, it AS ({' UNION ALL '.join(names)})"


_PHASES = "SELECT phase, round(max(seconds), 6) AS seconds FROM (SELECT user_id, event_type AS phase, sum(coalesce(value, 0)) AS seconds FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL) GROUP BY phase"
_ENERGY = """SELECT count(*) AS clients, round(sum(v.kwh), 6) AS kwh, round(sum(v.co2), 6) AS co2_kg FROM (SELECT user_id, arg_max({'kwh': value, 'co2': coalesce(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER), 0) / 100}, (ts, event_id)) AS v
FROM events WHERE event_type = 'purchase' AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id)"""
_STREAM_ROWS = " UNION ALL ".join(f"SELECT l_suppkey % {CLIENTS} AS client, {i} AS feature, {bin_sql(c, a, b, BINS)} AS bin, l_returnflag AS y, l_quantity AS q FROM lineitem" for i, (c, a, b) in enumerate((("l_quantity", "1.0::DOUBLE", "50.0::DOUBLE"), ("l_discount", "0.0::DOUBLE", "0.1::DOUBLE"))))
_STREAM = " UNION ALL ".join(f"SELECT l_suppkey % {CLIENTS} AS client, {i} AS feature, {bin_sql(c, a, b, BINS)} AS bin, l_returnflag AS y FROM lineitem WHERE {c} IS NOT NULL" for i, (c, a, b) in enumerate((("l_quantity", "1.0::DOUBLE", "50.0::DOUBLE"), ("l_discount", "0.0::DOUBLE", "0.1::DOUBLE"))))

#: Records that lack a client, clicks or purchases are out; of the others, each client's sums.
_RECORDS = """r AS (SELECT user_id AS client, CAST(ts AS DATE) AS day, coalesce(sum(value) FILTER (WHERE event_type = 'signup'), 0) AS load, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS pre,
  sum(value) FILTER (WHERE event_type = 'click') AS compute, sum(value) FILTER (WHERE event_type = 'purchase') AS comm FROM events GROUP BY ALL),
c AS (SELECT client, sum(load) AS load, sum(pre) AS pre, sum(compute) AS compute, sum(comm) AS comm FROM r WHERE client IS NOT NULL AND compute IS NOT NULL AND comm IS NOT NULL GROUP BY client)"""
#: Each time is the slowest client's; the server's own are summed, and go from what is left without a bound.
_PROFILE = f"""WITH {_RECORDS}, m AS (SELECT coalesce(max(load), 0) AS load, coalesce(max(pre), 0) AS pre, coalesce(max(compute), 0) AS compute, coalesce(max(comm), 0) AS comm FROM c),
s AS (SELECT coalesce(sum(value) FILTER (WHERE event_id % 2 = 0), 0) AS agg, coalesce(sum(value) FILTER (WHERE event_id % 2 <> 0), 0) AS mi FROM events WHERE event_type = 'error'),
t AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM events)
SELECT round(load, 6) AS load, round(pre, 6) AS pre, round(compute, 6) AS compute, round(comm, 6) AS comm, round(agg, 6) AS agg, round(mi, 6) AS mi, round(span - load, 6) AS total,
  round(greatest(0, span - load - compute - comm - pre) - agg - mi, 6) AS others FROM m, s, t"""
_INCOMPLETE = f"WITH {EMB_D.replace('FROM el JOIN rng', 'FROM (SELECT * FROM el WHERE client <> 1 OR feature % 2 = 0) el JOIN rng')}, ns AS (SELECT client, count(*) AS n FROM emb GROUP BY client), pc AS (SELECT feature, bin, y, sum(1.0 / n) / {CLIENTS}.0 AS p FROM d JOIN ns USING (client) GROUP BY ALL), fm AS {_mi('pc')}, {_SITE_PAIRS.replace('FROM pr JOIN ns', 'FROM (SELECT * FROM pr SEMI JOIN (SELECT k, j FROM pr GROUP BY k, j HAVING count(DISTINCT client) = 4) w USING (k, j)) pr JOIN ns')}, {_GREEDY.replace('GROUP BY k ORDER BY', 'GROUP BY k HAVING count(*) = 2 ORDER BY')}"
#: The cleaned values: missing ones, rows without class and sparse features dropped, medians filled in.
_CLEAN = f"""WITH {EMB_SQL}, h AS (SELECT row_id, row_id % 3 AS subject, y, feature, CASE WHEN feature % 2 = 0 AND x < 0 OR feature % 2 = 1 AND x < CAST(0.05 AS DOUBLE) THEN NULL ELSE x END AS x FROM el WHERE y <> 0),
f AS (SELECT feature FROM (SELECT subject, feature, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS q FROM h GROUP BY ALL) GROUP BY feature HAVING max(q) <= 0.5), m AS (SELECT feature, median(x) AS med FROM h GROUP BY feature),
cl AS (SELECT row_id, subject, y, feature, coalesce(x, med) AS x FROM h JOIN f USING (feature) JOIN m USING (feature))"""

def _arrived(rows, *lags):
    """The tables m, of messages with their batch, and w, of each batch with the watermark, in
    microseconds, that those before it leave; ``rows`` has id and ts."""
    more = "CASE " + " ".join(f"WHEN id % {n} = 0 THEN {days}" for n, days in reversed(lags)) + " ELSE 0 END"
    return f"SELECT *, CAST(floor((floor(epoch_us(ts) / 86400000000) + {more}) / 6) AS BIGINT) AS batch FROM ({rows})"


def _watermark(delay_us):
    return f"w AS (SELECT batch, coalesce(max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {delay_us}, 0) AS wm FROM (SELECT batch, max(epoch_us(ts)) AS last FROM m GROUP BY batch))"


_LATE_REPORTS = f"""WITH e AS ({_arrived("SELECT event_id AS id, ts, user_id AS client, value AS seconds FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL", (3, 1), (11, 6))}),
o AS (SELECT round, client, batch, m.ts AS ts, m.id AS id, m.seconds AS seconds FROM (SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS round, client, batch, min({{'ts': ts, 'id': id, 'seconds': seconds}}) AS m FROM e GROUP BY ALL)),
m AS (SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM o WHERE id % 5 = 0 UNION ALL SELECT * REPLACE (batch + 1 AS batch) FROM o WHERE id % 7 = 0) WHERE client % 10 <> 9 AND client < 1000),
{_watermark(86400000000)}, l AS (SELECT m.*, epoch_us(ts) <= wm AS late FROM m JOIN w USING (batch)),
f AS (SELECT round, client, min_by(id, batch) AS id, min_by(seconds, batch) AS seconds FROM l WHERE NOT late GROUP BY round, client)
SELECT round, count(*) AS clients, CAST(sum(id) AS BIGINT) AS ids, round(sum(seconds), 4) AS seconds, (SELECT count(*) FROM l WHERE late) AS late FROM f GROUP BY round"""
_CLOSED_ROUNDS = f"""WITH m AS ({_arrived(f"SELECT event_id AS id, ts, CAST(floor(epoch_us(ts) / {HOUR * 1000}) AS BIGINT) AS round, user_id % 8 AS client, list_filter(range(4), lambda p: (event_id + p) % 9 <> 0) AS pairs FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ('view', 'click')", (4, 1), (13, 7))}),
{_watermark(7200000000)}, l AS (SELECT m.*, (round * {HOUR} + {LIMIT}) * 1000 AS ends FROM m JOIN w USING (batch) WHERE epoch_us(ts) > wm AND wm < (round * {HOUR} + {LIMIT}) * 1000),
f AS (SELECT round, client, arg_min(pairs, (batch, ts, id)) AS pairs FROM l WHERE epoch_us(ts) <= ends AND client IN {EXPECTED} GROUP BY ALL),
r AS (SELECT round, any_value(ends) AS ends FROM l GROUP BY round),
n AS (SELECT round, count(*) AS clients FROM f GROUP BY round),
p AS (SELECT round, p, count(*) AS sent FROM (SELECT round, unnest(pairs) AS p FROM f) GROUP BY ALL),
x AS (SELECT round, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS excluded FROM p WHERE sent < {len(EXPECTED)} GROUP BY round)
SELECT round, coalesce(clients, 0) = {len(EXPECTED)} AS complete, coalesce(clients, 0) AS clients, coalesce(excluded, '') AS excluded FROM r LEFT JOIN n USING (round) LEFT JOIN x USING (round)
WHERE clients = {len(EXPECTED)} OR ends <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 7200000000 FROM m)"""

ORACLE = {
    "src_sensor_logs": f"WITH {EMB_SQL} SELECT row_id % 3 + 1 AS subject, feature, count(*) AS n, count(x) FILTER (WHERE x >= 0) AS present, round(sum(x) FILTER (WHERE x >= 0), 4) AS total FROM el WHERE y <> 0 GROUP BY ALL",
    "sink_cleaned": f"{_CLEAN} SELECT subject, y, count(DISTINCT row_id) AS n, count(DISTINCT feature) AS width, round(sum(x), 4) AS total FROM cl GROUP BY subject, y",
    "stream_information": f"WITH c AS (SELECT feature, bin, y, count(*) AS c FROM ({_STREAM}) WHERE y IS NOT NULL GROUP BY ALL), pc AS (SELECT *, c / sum(c) OVER (PARTITION BY feature) AS p FROM c), fm AS {_mi('pc')} SELECT feature, round(mi, 6) AS mi FROM fm",
    "stream_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY event_type",
    "select_mim_pooled": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')} SELECT row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS rank, feature, round(mi, 6) AS score FROM fm ORDER BY rank LIMIT {K}",
    "src_matrix_text": f"WITH {EMB_SQL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, y, round(list_sum(features), 6) AS total, len(features) AS width FROM emb",
    "src_union_splits": f"WITH {EMB_SQL} SELECT row_id, y, CASE WHEN row_id % 5 = 0 THEN 'valid' ELSE 'train' END AS split FROM emb",
    "src_selected_read": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')} SELECT row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS rank, feature FROM fm ORDER BY rank LIMIT {K}",
    "sink_client_parts": f"WITH {EMB_SQL} SELECT client, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM emb GROUP BY client",
    "prep_label_nonneg": f"WITH {EMB_SQL} SELECT row_id, greatest(y - 3, 0) AS y FROM emb",
    "prep_relabel": f"WITH {EMB_SQL} SELECT row_id, dense_rank() OVER (ORDER BY y * 7 - 9) - 1 AS y FROM emb",
    "prep_sentinel_null": f"WITH {_DIRTY} SELECT subject, feature, count(*) AS n, count(x) AS present FROM dl GROUP BY ALL",
    "prep_drop_null_class": f"WITH {EMB_SQL} SELECT row_id, y FROM emb WHERE y <> 0",
    "prep_every_nth": f"WITH {EMB_SQL} SELECT client, row_id FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY row_id) AS o FROM emb) WHERE (o - 1) % 3 = 0",
    "prep_null_fraction": f"WITH {_DIRTY} SELECT subject, feature, round(fraction, 6) AS fraction FROM fr",
    "prep_drop_sparse": f"WITH {_DIRTY} SELECT feature, max(fraction) <= 0.5 AS kept FROM fr GROUP BY feature",
    "prep_impute_median": f"WITH {EMB_SQL}, m AS (SELECT feature, median(x) AS med FROM el WHERE x >= 0 GROUP BY feature) SELECT row_id, feature, round(CASE WHEN x >= 0 THEN x ELSE med END, 6) AS x FROM el LEFT JOIN m USING (feature)",
    "prep_clean_pipeline": f"{_CLEAN} SELECT row_id, y, feature, round(x, 6) AS x FROM cl",
    "select_project_features": f"WITH {EMB_SQL} SELECT row_id, unnest([0, 1, 2]) AS place, round(unnest([{', '.join(f'features[{i + 1}]' for i in PICKED)}]), 6) AS x FROM emb",
    "disc_equalwidth": f"WITH {EMB_D} SELECT row_id, feature, bin FROM d",
    "disc_given_ranges": f"WITH {EMB_SQL} SELECT row_id, feature, {bin_sql('x', 'CAST(-0.1 AS DOUBLE)', 'CAST(0.1 AS DOUBLE)', BINS)} AS bin FROM el",
    "site_assign_join": f"WITH {EMB_SQL} SELECT row_id % 3 AS client, count(*) AS n, CAST(sum(y) AS BIGINT) AS total FROM emb GROUP BY 1",
    "jmi_pair_counts": f"WITH {EMB_D} SELECT a.feature AS k, 0 AS j, a.bin AS bin_k, b.bin AS bin_j, a.y, count(*) AS c FROM d a JOIN d b ON a.row_id = b.row_id AND b.feature = 0 AND a.feature <> 0 GROUP BY ALL",
    "tpr_overlap": f"WITH {EMB_SQL}, i AS (SELECT DISTINCT feature FROM el WHERE feature IN {IDEAL}), e AS (SELECT DISTINCT feature FROM el WHERE feature IN {FOUND}) SELECT (SELECT count(*) FROM i JOIN e USING (feature)) AS overlap, (SELECT count(*) FROM i) AS k, (SELECT count(*) FROM i JOIN e USING (feature)) / (SELECT count(*) FROM i) AS tpr",
    "jmi_candidates": f"WITH {EMB_SQL} SELECT DISTINCT feature FROM el WHERE feature NOT IN {PICKED}",
    "site_label_dispersion": f"WITH {EMB_SQL} SELECT a.client, b.label, count(emb.row_id) AS c FROM (SELECT DISTINCT client FROM emb) a CROSS JOIN (SELECT DISTINCT CAST(y AS VARCHAR) AS label FROM emb) b LEFT JOIN emb ON emb.client = a.client AND CAST(emb.y AS VARCHAR) = b.label GROUP BY ALL",
    "site_extremes": f"WITH {LI_SQL} SELECT client, feature, min(x) AS mn, max(x) AS mx FROM el GROUP BY ALL",
    "global_ranges": f"WITH {LI_SQL} SELECT feature, min(x) AS mn, max(x) AS mx FROM el GROUP BY ALL",
    "label_arity": f"WITH {LI_SQL} SELECT count(DISTINCT y) AS classes FROM li",
    "joint_counts": f"WITH {LI_D} SELECT feature, bin, y, count(*) AS c FROM d GROUP BY ALL",
    "joint_counts_blocks": f"WITH {EMB_D} SELECT client, feature, bin, y, count(*) AS c FROM d GROUP BY ALL",
    "joint_counts_raw_blocks": f"WITH {EMB_D} SELECT client, feature, bin, y, count(*) AS c FROM d GROUP BY ALL",
    "mi_all_pairs": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')}, {_PAIRS}, pm AS {_mi('pp', 'k, j', 'bin_k, bin_j')} SELECT k, j, round(mi, 6) AS mi FROM pm WHERE k < j UNION ALL SELECT feature, feature, round(mi, 6) FROM fm",
    "mi_all_pairs_sites": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')}, {_PAIRS}, pm AS {_mi('pp', 'k, j', 'bin_k, bin_j')} SELECT k, j, round(mi, 6) AS mi FROM pm WHERE k < j UNION ALL SELECT feature, feature, round(mi, 6) FROM fm",
    "site_joint_probs": f"WITH {LI_D}, {_SITE} SELECT client, feature, bin, y, round(p, 6) AS p FROM sp",
    "site_pair_probs": f"WITH {LI_SQL}, rng AS (SELECT feature, min(x) AS mn, max(x) AS mx FROM el GROUP BY feature), w AS (SELECT *, row_number() OVER () AS rid FROM li), l AS (SELECT rid, client, y, unnest(range(0, 5)) AS feature, unnest(features) AS x FROM w), d AS (SELECT rid, client, y, feature, {bin_sql('x', 'mn', 'mx', BINS)} AS bin FROM l JOIN rng USING (feature)), ns AS (SELECT client, count(*) AS n FROM w GROUP BY client) SELECT a.client, a.feature AS k, 0 AS j, a.bin AS bin_k, b.bin AS bin_j, a.y, round(count(*) / any_value(n), 6) AS p FROM d a JOIN d b ON a.rid = b.rid AND b.feature = 0 AND a.feature <> 0 JOIN ns ON ns.client = a.client GROUP BY a.client, a.feature, a.bin, b.bin, a.y",
    "combine_simple": f"WITH {LI_D}, {_SITE} SELECT feature, bin, y, round(sum(p) / {CLIENTS}.0, 6) AS p FROM sp GROUP BY ALL",
    "combine_weighted": f"WITH {LI_D}, {_SITE} SELECT feature, bin, y, round(sum(p * n) / (SELECT sum(n) FROM ns), 6) AS p FROM sp GROUP BY feature, bin, y",
    "mi_feature_bits": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')} SELECT feature, round(mi, 6) AS mi FROM fm",
    "mi_feature_nats": f"WITH {LI_D}, {_COUNTS}, fm AS {_mi('pc', log='ln')} SELECT feature, round(mi, 6) AS mi FROM fm",
    "mi_pair_bits": f"WITH {EMB_D}, {_PAIRS}, pm AS {_mi('pp', 'k, j', 'bin_k, bin_j')} SELECT k, j, round(mi, 6) AS mi FROM pm WHERE j = 0",
    "mi_gap_merge": f"WITH {EMB_D}, c AS (SELECT feature, CASE WHEN bin = 1 THEN 0 ELSE bin END AS b, y, count(*) AS c FROM d GROUP BY ALL), g AS (SELECT feature, min(b) AS lo, max(b) AS hi, count(DISTINCT b) AS a FROM c GROUP BY feature), h AS (SELECT feature, CASE WHEN lo = hi THEN 0 ELSE least(len(list_filter(range(1, a + 1), lambda i: b >= lo + i * ((hi - lo) / a))), a - 1) END AS bin, y, c FROM c JOIN g USING (feature)), pc AS (SELECT feature, bin, y, sum(c) / sum(sum(c)) OVER (PARTITION BY feature) AS p FROM h GROUP BY feature, bin, y), fm AS {_mi('pc', log='ln')} SELECT feature, round(mi, 6) AS mi FROM fm",
    "select_mim_sites": f"WITH {EMB_D}, {_SITE}, pc AS (SELECT feature, bin, y, sum(p) / {CLIENTS}.0 AS p FROM sp GROUP BY ALL), fm AS {_mi('pc')} SELECT row_number() OVER (ORDER BY round(mi, 9) DESC, feature) AS rank, feature, round(mi, 6) AS score FROM fm WHERE mi > 0 ORDER BY rank LIMIT {K}",
    "select_jmi_pooled": f"WITH {EMB_D}, {_COUNTS}, fm AS {_mi('pc')}, {_PAIRS}, {_GREEDY}",
    "select_jmi_sites": f"WITH {EMB_D}, {_SITE}, pc AS (SELECT feature, bin, y, sum(p) / {CLIENTS}.0 AS p FROM sp GROUP BY ALL), fm AS {_mi('pc')}, {_SITE_PAIRS}, {_GREEDY}",
    "site_iid": f"WITH {EMB_SQL} SELECT row_id, CAST(floor(o / q) AS BIGINT) AS client FROM (SELECT row_id, row_number() OVER (ORDER BY md5('0:' || row_id), row_id) - 1 AS o, floor(count(*) OVER () / 3) AS q FROM emb) WHERE floor(o / q) < 3",
    "site_noniid_shards": f"WITH {EMB_SQL}, q AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, CAST(floor(count(*) OVER () / {2 * CLIENTS}) AS BIGINT) AS size FROM emb), r AS (SELECT *, row_number() OVER (ORDER BY y, row_id) - 1 AS o FROM q WHERE i < size * {2 * CLIENTS}) SELECT row_id, {list(OWNERS)}[CAST(floor(o / size) AS BIGINT) + 1] AS client FROM r",
    "site_noniid_uneven": f"WITH {EMB_SQL}, r AS (SELECT row_id, row_number() OVER (ORDER BY y, row_id) - 1 AS o, count(*) OVER () AS n FROM emb) SELECT row_id, " + " + ".join(f"CAST(o >= {' + '.join(f'floor(n * CAST({s} AS DOUBLE))' for s in SHARES[: i + 1])} AS BIGINT)" for i in range(len(SHARES))) + " AS client FROM r",
    "site_by_subject": f"WITH {EMB_SQL} SELECT row_id, dense_rank() OVER (ORDER BY row_id % 3 * 2 + 1) - 1 AS client FROM emb",
    "eval_split": f"WITH {EMB_SQL}, {_split()} SELECT row_id, is_test FROM s",
    "eval_split_stratified": f"WITH {EMB_SQL} SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY md5('0:' || row_id), row_id) <= ceil(CAST({RATIO} AS DOUBLE) * count(*) OVER (PARTITION BY y)) AS is_test FROM emb",
    "eval_scale": f"WITH {_S}, {_STATS} SELECT row_id, feature, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS x FROM sl JOIN st USING (feature)",
    "eval_gnb": f"WITH {_S}, {_gnb()} SELECT * FROM gp",
    "eval_knn": f"WITH {_KNN} SELECT * FROM gp",
    "eval_knn_nearest": f"WITH {_S}, n AS (SELECT t.row_id, r.row_id AS near, r.y AS label, pow(list_distance(t.features, r.features), 2) AS d, row_number() OVER (PARTITION BY t.row_id ORDER BY list_distance(t.features, r.features), r.row_id) AS o FROM s t JOIN s r ON t.is_test AND NOT r.is_test) SELECT row_id, near, label, round(d, 6) AS d FROM n WHERE o <= 5",
    "eval_lr_gradient": f"WITH {_S} SELECT y AS label, 0.0 AS slope FROM s WHERE NOT is_test GROUP BY y",
    "eval_confusion": f"WITH {_KNN} SELECT * FROM cm",
    "eval_class_report": f"WITH {_KNN}, {_REPORT}",
    "eval_accuracy_micro": f"WITH {_S}, {_gnb()}, a AS (SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS a FROM gp) SELECT a AS accuracy, a AS precision_micro, a AS recall_micro, a AS f1_micro FROM a",
    "eval_iterations": f"{_rounds(2)} SELECT count(*) AS iterations, round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) AS std_accuracy FROM it",
    "eval_loop_gnb": f"{_rounds(2, f'feature IN {PICKED}')} SELECT iteration, round(a, 6) AS accuracy, round(a, 6) AS precision_micro, round(a, 6) AS recall_micro, round(a, 6) AS f1_micro FROM it",
    "telemetry_records": f"WITH {_RECORDS} SELECT client, round(load, 6) AS load, round(pre, 6) AS pre, round(compute, 6) AS compute, round(comm, 6) AS comm FROM c",
    "telemetry_profile": _PROFILE,
    "json_messages": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(user_id) AS BIGINT) AS clients, CAST(sum(length(to_json({'id': event_id, 'client': user_id})::VARCHAR)) AS BIGINT) AS chars FROM events GROUP BY event_type",
    "combine_fallback": f"WITH {LI_D}, {_SITE} SELECT feature, bin, y, round(sum(p) / {CLIENTS}.0, 6) AS p FROM sp GROUP BY ALL",
    "combine_valid": f"WITH {LI_D}, {_SITE} SELECT feature, bin, y, round(sum(p) / 2, 6) AS p FROM sp WHERE client NOT IN (1, 2) GROUP BY ALL",
    "select_jmi_incomplete": _INCOMPLETE,
    "telemetry_phase_times": _PHASES,
    "telemetry_energy": _ENERGY,
    "stream_joint_counts": f"SELECT client, feature, bin, y, count(*) AS c FROM ({_STREAM}) WHERE y IS NOT NULL GROUP BY ALL",
    "stream_first_reports": "SELECT event_type AS round, count(*) AS clients, count(*) >= (SELECT count(DISTINCT user_id) FROM events) AS complete, CAST(sum(r.event_id) AS BIGINT) AS ids, round(sum(r.value), 4) AS seconds FROM (SELECT event_type, user_id, min({'ts': ts, 'event_id': event_id, 'value': value}) AS r FROM events WHERE user_id IS NOT NULL GROUP BY ALL) GROUP BY event_type",
    "stream_phase_times": _PHASES,
    "stream_energy": _ENERGY,
    "stream_late_reports": _LATE_REPORTS,
    "stream_closed_rounds": _CLOSED_ROUNDS,
    "stream_count_store": f"WITH c AS (SELECT feature, bin, y, count(*) AS c FROM ({_STREAM_ROWS}) WHERE y IS NOT NULL AND bin IS NOT NULL AND client <> 3 AND (client <> 2 OR q <= 30) GROUP BY ALL), pc AS (SELECT *, c / sum(c) OVER (PARTITION BY feature) AS p FROM c), fm AS {_mi('pc')} SELECT feature, round(mi, 6) AS mi FROM fm",
}
