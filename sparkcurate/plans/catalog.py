"""The registered queries: every operator run over the given tables.

A query is a function of (session, data folder). The SQL each is checked against is in
``oracle.py`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcurate import constants as K
from sparkcurate.class_maps import PLANTDOC, PLANTVILLAGE
from sparkcurate.functions import hashing as H
from sparkcurate.functions import scores as S
from sparkcurate.functions import text as X
from sparkcurate.operators import audit as AU
from sparkcurate.operators import balance as B
from sparkcurate.operators import calibration as C
from sparkcurate.operators import decision as D
from sparkcurate.operators import evaluation as E
from sparkcurate.operators import grouping as G
from sparkcurate.operators import history as HI
from sparkcurate.operators import labeling as L
from sparkcurate.operators import splitting as SP
from sparkcurate.plans import adapters as A
from sparkcurate.session import new_path, store
from sparkcurate.sources import files as FS
from sparkcurate.sources import images as IM
from sparkcurate.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DOC_DISTANCE = 2
SWEEP_DISTANCES = [0, 2, 4, 6, 8, 10, 12]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# --- hashes and near-duplicate groups ---------------------------------------------------------


def hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash table every later stage reads; hashing a file is the dear part, so it is written
    out once per job."""
    return store(A.doc_hashes(spark, sf_dir))


def doc_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = hash_store(spark, sf_dir)
    return files, G.near_dup_groups(files, DOC_DISTANCE)


def row_split_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files split row by row, and their groups."""
    listed = store(SP.row_split(A.doc_hashes(spark, sf_dir)))
    return listed, G.near_dup_groups(listed, DOC_DISTANCE)


@query
def near_dup_hash(spark, sf_dir):
    files = A.doc_hashes(spark, sf_dir)
    return files.select("id", "label", F.col("orbit")[0].cast("string").alias("hash"))


@query
def orbit_hash(spark, sf_dir):
    rows = A.square_grids(spark, sf_dir)
    return rows.select("id", *[F.col("orbit")[k].alias(f"h{k}") for k in range(8)])


@query
def orbit_signature_dups(spark, sf_dir):
    sigs = G.signatures(A.doc_hashes(spark, sf_dir))
    return sigs.filter("n_files > 1").select(F.col("signature")[0].alias("hash"), "rep", "n_files")


@query
def orbit_self_distance(spark, sf_dir):
    """How far each grid lies from its own mirror images: distance of the orbit to each move."""
    rows = A.square_grids(spark, sf_dir)
    first, rest = F.slice("orbit", 1, 1), F.slice("orbit", 2, 7)
    return rows.select("id", H.orbit_distance(first, rest).alias("distance"))


@query
def hash_bands(spark, sf_dir):
    files = A.doc_hashes(spark, sf_dir).filter("orbit is not null")
    bands = files.select("id", F.explode(H.band_values(F.col("orbit")[0], 5)).alias("b"))
    return bands.select("id", "b.band", "b.value")


@query
def near_dup_edges(spark, sf_dir):
    return G.near_dup_edges(hash_store(spark, sf_dir), DOC_DISTANCE)


@query
def near_dup_groups(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    return G.dense_group_ids(store(groups)).select("id", "group_id", "dense_id")


@query
def group_stats(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    return rounded(G.group_stats(groups), "redundancy_pct")


@query
def tolerance_sweep(spark, sf_dir):
    listed = store(SP.row_split(A.doc_hashes(spark, sf_dir)))
    return rounded(G.tolerance_sweep(listed, SWEEP_DISTANCES), "leaked_pct")


# --- splits and leakage -----------------------------------------------------------------------


@query
def group_split(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    return SP.group_split(store(groups)).select("id", "group_id", "label", "split")


@query
def row_split(spark, sf_dir):
    files = A.labelled_docs(spark, sf_dir)
    return SP.row_split(files).select("id", "label", "split")


@query
def leak_report_row_split(spark, sf_dir):
    listed, groups = row_split_groups(spark, sf_dir)
    return AU.flat_report(AU.leakage_report(groups, listed, DOC_DISTANCE))


@query
def leak_report_group_split(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    kept = store(SP.group_split(store(groups)))
    return AU.flat_report(AU.leakage_report(kept, kept, DOC_DISTANCE))


@query
def leak_matrix(spark, sf_dir):
    _, groups = row_split_groups(spark, sf_dir)
    return AU.leak_matrix(groups)


@query
def leak_before_after(spark, sf_dir):
    listed, groups = row_split_groups(spark, sf_dir)
    groups = store(groups)
    kept = store(SP.group_split(groups))
    before = AU.leakage_report(groups, listed, DOC_DISTANCE)
    after = AU.leakage_report(kept, kept, DOC_DISTANCE)
    return rounded(AU.compare_reports(before, after), "change")


@query
def leak_examples(spark, sf_dir):
    _, groups = row_split_groups(spark, sf_dir)
    return AU.leak_examples(store(groups), 15)


@query
def leaked_rows(spark, sf_dir):
    _, groups = row_split_groups(spark, sf_dir)
    return AU.leaked_rows(store(groups)).select("id", "split", "group_id")


@query
def clean_test(spark, sf_dir):
    _, groups = row_split_groups(spark, sf_dir)
    return AU.clean_test(store(groups)).select("id", "group_id")


@query
def label_conflicts(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    return AU.label_conflicts(groups)


@query
def drop_conflicts(spark, sf_dir):
    _, groups = doc_groups(spark, sf_dir)
    return AU.drop_conflicts(store(groups)).select("id", "group_id", "label")


@query
def split_metadata(spark, sf_dir):
    files, groups = doc_groups(spark, sf_dir)
    groups = store(groups)
    kept = store(SP.group_split(groups))
    return AU.split_metadata(files, groups, kept, DOC_DISTANCE)


@query
def audit_gate(spark, sf_dir):
    listed, groups = row_split_groups(spark, sf_dir)
    report = AU.audit_gate(AU.leakage_report(groups, listed, DOC_DISTANCE))
    return AU.flat_report(report).select("test_leaked_pct", "verdict", "passed", "warning")


@query
def incremental_hash_plan(spark, sf_dir):
    """A store that knows every file but those of two sources; a third source's files changed
    length since."""
    files = A.doc_hashes(spark, sf_dir).select(
        "path", "source", F.col("n_chars").alias("length"),
        F.timestamp_seconds(F.col("id")).alias("modificationTime"), "orbit",
    )
    store = files.filter("source not in ('src1', 'src2')").select(
        "path",
        F.when(F.col("source") == "src3", F.col("length") + 1).otherwise(F.col("length")).alias("length"),
        F.unix_timestamp("modificationTime").alias("mtime_s"),
        "orbit",
    )
    known, new = FS.hash_plan(files.drop("orbit"), store)
    return known.select(
        "path", F.when(F.col("orbit").isNull(), "corrupt").otherwise("known").alias("state")
    ).unionByName(new.select("path", F.lit("to_hash").alias("state")))


# --- names, labels, annotations ---------------------------------------------------------------


@query
def filter_extensions(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    presets = {
        "images": K.IMAGE_EXTENSIONS,
        "consolidation": K.CONSOLIDATION_EXTENSIONS,
        "field": K.FIELD_EXTENSIONS,
    }
    flags = [X.has_extension(F.col("path"), exts).cast("bigint") for exts in presets.values()]
    by_ext = files.groupBy(X.file_extension(F.col("path")).alias("ext"))
    return by_ext.agg(*[F.sum(flag).alias(name) for name, flag in zip(presets, flags)])


@query
def parse_split_path(spark, sf_dir):
    files = A.doc_hashes(spark, sf_dir).select("id", "path")
    return FS.parse_split_path(files).select("id", "split", "label", "name")


def class_map(spark: SparkSession) -> DataFrame:
    """Both folder maps as one table, read from their JSON form."""
    import json

    texts = [
        (json.dumps({"_note": "folder -> class", **m}, ensure_ascii=False),)
        for m in (PLANTVILLAGE, PLANTDOC)
    ]
    return FS.class_map_rows(spark.createDataFrame(texts, "value string"))


@query
def class_map_join(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", "path", "folder")
    return L.join_class_map(files, class_map(spark)).select("id", "folder", "class")


@query
def name_tokens(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    return files.select("id", F.explode(X.name_tokens(F.col("folder"))).alias("token"))


@query
def infer_label(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    return files.select("id", "folder", X.infer_label(F.col("folder")).alias("label"))


@query
def label_from_path(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    found = files.withColumn("d", L.deciding_dir(F.col("path")))
    return found.select("id", "path", "d.label", "d.folder")


@query
def unrecognized_dirs(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", "path")
    return L.unrecognized_dirs(L.label_files(files))


@query
def binary_shortcut(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", "path")
    return L.label_files(files).select("id", "source", "shortcut", "label", "status")


@query
def label_audit(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", "path")
    return L.label_audit(L.label_files(files))


@query
def label_status(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", "path")
    return L.status_counts(L.label_files(files))


@query
def flat_names(spark, sf_dir):
    files = A.paths(spark, sf_dir).filter(X.has_extension(F.col("path")))
    indexed = SP.running_index(files, by="folder")
    return indexed.select(
        "id",
        L.flat_name(F.col("path")).alias("flat_name"),
        "class_index",
        X.consolidated_name(F.col("source"), F.col("class_index"), F.col("path")).alias("dest"),
    )


@query
def source_of(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    name = F.when(F.col("id") % 4 == 0, X.file_name(F.col("path"))).otherwise(L.flat_name(F.col("path")))
    return files.select("id", X.source_of(name).alias("source"))


@query
def keep_list(spark, sf_dir):
    files = A.paths(spark, sf_dir).withColumn("label", X.keep_list_label(F.col("folder")))
    kept = files.filter(F.col("label").isNotNull() & X.has_extension(F.col("path")))
    return kept.select("id", "label", X.keep_list_name(F.col("folder"), F.col("path")).alias("dest"))


@query
def skip_sources(spark, sf_dir):
    """Sources renamed so that each skip rule meets some of them; what is staged remains."""
    files = A.paths(spark, sf_dir)
    k = A.source_number()
    tagged = files.withColumn(
        "source",
        F.when(k == 1, K.KEEP_LIST_SOURCE)
        .when(k == 2, K.SKIP_SOURCES[0])
        .when(k.between(3, 5), F.concat(F.lit(K.SKIP_SOURCE_PREFIX), F.col("source")))
        .otherwise(F.col("source")),
    )
    staged = tagged.filter(~L.skipped_source(F.col("source")) & X.has_extension(F.col("path")))
    return staged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def class_root(spark, sf_dir):
    return L.class_roots(A.paths(spark, sf_dir).select("path"))


@query
def admission(spark, sf_dir):
    """Pages as uploads: the type from the page number, the length from the page itself."""
    pages = A.table(spark, sf_dir, "pages")
    types = X.lit_strings([*K.ALLOWED_CONTENT_TYPES, "image/gif", "text/html"])
    kind = F.when(F.col("page_id") % 7 < 6, types[(F.col("page_id") % 7).cast("int")])
    return pages.select(
        "page_id", D.admission(kind, F.octet_length("html"), max_bytes=2000).alias("reject_code")
    )


@query
def truth_alias(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    names = X.lit_strings(["healthy", "ANOMALOUS", "Not_a_leaf", "nao_folha", "leaves"])
    folder = names[(F.col("id") % 5).cast("int")]
    return files.groupBy(folder.alias("folder"), D.truth_of_folder(folder).alias("truth")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def sufficiency(spark, sf_dir):
    files = L.join_class_map(A.paths(spark, sf_dir), class_map(spark))
    return rounded(B.class_sufficiency(files, K.CLASS_NAMES, "class"), "pct")


@query
def source_class_counts(spark, sf_dir):
    files = L.join_class_map(A.paths(spark, sf_dir), class_map(spark))
    return B.source_class_counts(files, "class")


@query
def annotation_lines(spark, sf_dir):
    lines = A.box_lines(spark, sf_dir)
    return lines.groupBy("dataset", L.class_id(F.col("line")).alias("class_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def annotation_labels(spark, sf_dir):
    datasets = [(f"boxes{k}", f"nc: 4\nnames: [{', '.join(A.BOX_NAMES)}]\n") for k in range(3)]
    names = FS.annotation_names(spark.createDataFrame(datasets, "dataset string, value string"))
    found = L.find_annotations(A.box_images(spark, sf_dir), A.box_lines(spark, sf_dir))
    return L.annotation_labels(found, names)


@query
def dest_dedupe(spark, sf_dir):
    files = A.paths(spark, sf_dir).withColumn(
        "dest", F.concat("folder", F.lit("/"), (F.col("id") % 40).cast("string"))
    )
    return L.keep_first(files.select("dest", "path", "id"))


@query
def idempotent_copy(spark, sf_dir):
    files = A.paths(spark, sf_dir).select("id", L.flat_name(F.col("path")).alias("dest"))
    return L.copy_counts(files, files.filter("id % 3 = 0"))


@query
def source_union(spark, sf_dir):
    files = A.paths(spark, sf_dir)
    parts = {
        "first_map": L.join_class_map(files, class_map(spark)).select("id", "class"),
        "by_name": files.select("id", X.infer_label(F.col("folder")).alias("class")).filter("class is not null"),
    }
    return B.union_sources(parts).groupBy("tag", "class").agg(F.count(F.lit(1)).alias("n"))


# --- balance and sampling ---------------------------------------------------------------------


def split_docs(spark, sf_dir) -> DataFrame:
    return SP.row_split(A.labelled_docs(spark, sf_dir))


@query
def split_label_counts(spark, sf_dir):
    return rounded(B.split_label_counts(split_docs(spark, sf_dir)), "ratio")


@query
def dataset_alerts(spark, sf_dir):
    return rounded(B.dataset_alerts(store(split_docs(spark, sf_dir))), "ratio")


@query
def total_alerts(spark, sf_dir):
    return rounded(B.total_alerts(store(split_docs(spark, sf_dir))), "ratio")


@query
def required_cells(spark, sf_dir):
    """Which split x label x toxic cells no row fills."""
    rows = split_docs(spark, sf_dir).withColumn("toxic", F.col("toxic").cast("string"))
    return B.missing_cells(rows, {"split": K.SPLITS, "label": K.LABELS, "toxic": ("0", "1", "2")})


@query
def class_distribution(spark, sf_dir):
    return B.class_distribution(A.labelled_docs(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return rounded(B.class_weights(A.labelled_docs(spark, sf_dir)), "weight", "max_min_ratio")


@query
def class_weights_with_absent(spark, sf_dir):
    rows = A.labelled_docs(spark, sf_dir)
    weights = B.class_weights(rows, classes=[*K.LABELS, "unseen"])
    return rounded(weights, "weight", "max_min_ratio")


@query
def loss_weights(spark, sf_dir):
    return rounded(
        B.loss_weights(A.labelled_docs(spark, sf_dir)), "healthy_weight", "anomalous_weight", "ratio"
    )


@query
def source_pivot(spark, sf_dir):
    return B.source_pivot(split_docs(spark, sf_dir))


@query
def class_cap(spark, sf_dir):
    return SP.class_cap(A.labelled_docs(spark, sf_dir), 50).select("id", "label")


@query
def capped_sufficiency(spark, sf_dir):
    capped = SP.class_cap(A.labelled_docs(spark, sf_dir), 50)
    return rounded(B.class_sufficiency(capped, K.LABELS, "label"), "pct")


@query
def sample_grid(spark, sf_dir):
    return SP.sample_grid(A.labelled_docs(spark, sf_dir)).select("id", "label", "slot")


@query
def balanced_resample(spark, sf_dir):
    rows = store(A.labelled_docs(spark, sf_dir).select("id", "path", "label"))
    return SP.balanced_resample(rows).select("draw", "label", "id")


#: Six classes of very different weight; the others are never drawn.
DRAW_WEIGHTS = {0: 5.0, 1: 0.5, 2: 3.0, 3: 1.0, 4: 2.25, 5: 0.125}


@query
def weighted_resample(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("vec/"), F.col("vec_id")).alias("path"))
    return SP.balanced_resample(store(rows), weights=DRAW_WEIGHTS).select("draw", "label", "vec_id")


@query
def same_class_fill(spark, sf_dir):
    """Every document has a label by its source; one without a quality label is unreadable."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = A.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    rows = store(
        docs.join(known, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            "lang",
            F.coalesce("known", F.lit(False)).alias("readable"),
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        )
    )
    return SP.same_class_fill(rows, "id", "lang", "readable", "path").select("id", "lang", "readable", "used")


# --- scores, calibration, evaluation ----------------------------------------------------------


@query
def softmax_scores(spark, sf_dir):
    rows = A.scores10(spark, sf_dir)
    names = X.lit_strings([f"class_{k}" for k in range(10)])
    ranked = rows.withColumn("p", S.softmax(F.col("logits"))).withColumn(
        "r", S.rank_scores(F.col("p"), names)
    )
    return rounded(
        ranked.select(
            "id",
            S.argmax(F.col("p")).alias("pred"),
            F.col("r")[0]["name"].alias("first"),
            F.col("r")[1]["name"].alias("second"),
            F.col("r")[0]["score"].alias("first_score"),
            F.col("r")[9]["score"].alias("last_score"),
        ),
        "first_score",
        "last_score",
    )


@query
def confusion(spark, sf_dir):
    return E.confusion_matrix(C.predictions(A.scores10(spark, sf_dir)))


@query
def headline_metrics(spark, sf_dir):
    preds = C.predictions(A.scores10(spark, sf_dir)).unionByName(C.predictions(A.scores2(spark, sf_dir).drop("toxic")))
    return rounded(
        E.headline(preds), "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro"
    )


@query
def per_class_report(spark, sf_dir):
    return rounded(E.per_class(C.predictions(A.scores10(spark, sf_dir))), "precision", "recall", "f1")


@query
def roc_auc(spark, sf_dir):
    rows = A.scores2(spark, sf_dir).withColumn("score", S.softmax(F.col("logits"))[1])
    # A cut of the same scores to four digits makes many ties.
    tied = rows.withColumn("model", F.concat("model", F.lit("_tied"))).withColumn("score", F.floor(F.col("score") * 20) / 20)
    both = store(rows.unionByName(tied).select("model", "label_idx", "score"))
    return rounded(E.roc_auc(both), "roc_auc")


@query
def ece(spark, sf_dir):
    preds = C.predictions(A.scores10(spark, sf_dir)).unionByName(C.predictions(A.scores2(spark, sf_dir).drop("toxic")))
    return rounded(C.calibration_error(preds), "ece")


@query
def reliability(spark, sf_dir):
    preds = C.predictions(A.scores2(spark, sf_dir))
    return rounded(C.reliability(preds), "accuracy", "mean_confidence", "center")


@query
def mean_confidence(spark, sf_dir):
    rows = A.scores10(spark, sf_dir)
    before = C.mean_confidence(C.predictions(rows)).withColumn("stage", F.lit("before"))
    after = C.mean_confidence(C.predictions(rows, 3.0)).withColumn("stage", F.lit("after"))
    return rounded(before.unionByName(after), "mean_confidence", "accuracy")


CURVE = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]


@query
def nll_curve(spark, sf_dir):
    return rounded(C.nll_curve(A.scores2(spark, sf_dir), CURVE), "nll")


@query
def fit_temperature(spark, sf_dir):
    fitted = C.fit_temperature(A.scores2(spark, sf_dir).filter("split = 'val'"), split="val")
    return rounded(fitted.select("model", "temperature", "at_bound"), "temperature", digits=4)


@query
def fit_temperature_saturated(spark, sf_dir):
    """The same scores sixty times as far apart: all probabilities are 0 or 1 in doubles."""
    val = A.scores2(spark, sf_dir).filter("split = 'val'")
    far = val.withColumn("logits", F.transform("logits", lambda z: z * 60.0))
    fitted = C.fit_temperature(far, split="val")
    return rounded(fitted.select("model", "temperature", "at_bound"), "temperature", digits=3)


@query
def pick_threshold(spark, sf_dir):
    preds = C.predictions(A.scores2(spark, sf_dir).filter("split = 'val'"))
    return rounded(C.pick_threshold(preds, target=0.87), "threshold", "coverage", "selective_accuracy")


FIXED_TEMPERATURES = (("m_len", 1.5), ("m_sharp", 4.0))


@query
def calibration_row(spark, sf_dir):
    fitted = spark.createDataFrame(list(FIXED_TEMPERATURES), "model string, temperature double")
    return C.calibration_rows(A.scores2(spark, sf_dir).filter("split = 'val'"), fitted)


@query
def model_comparison(spark, sf_dir):
    fitted = spark.createDataFrame(list(FIXED_TEMPERATURES), "model string, temperature double")
    table = E.model_comparison(store(A.scores2(spark, sf_dir).filter("split = 'test'")), fitted)
    return rounded(
        table, "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
        "roc_auc", "ece", "mean_confidence",
    )


@query
def smoothed_ce(spark, sf_dir):
    rows = A.scores2(spark, sf_dir)
    weights = B.class_weights(A.labelled_docs(spark, sf_dir), "label_idx")
    return rounded(E.smoothed_loss(rows, weights, 2), "loss")


@query
def smoothed_ce_absent_class(spark, sf_dir):
    """Three classes of which the first has no row: labels and logits move up by one."""
    rows = A.scores2(spark, sf_dir).withColumn("label_idx", F.col("label_idx") + 1)
    rows = rows.withColumn("logits", F.concat(F.array(F.lit(-3.0)), "logits"))
    labelled = A.labelled_docs(spark, sf_dir).withColumn("label_idx", F.col("label_idx") + 1)
    return rounded(E.smoothed_loss(rows, B.class_weights(labelled, "label_idx"), 3), "loss")


@query
def fn_fp_rank(spark, sf_dir):
    return E.fn_fp_ranking(C.predictions(A.scores2(spark, sf_dir)))


@query
def select_model(spark, sf_dir):
    chosen = E.select_model(A.scores2(spark, sf_dir).filter("split = 'val'"))
    return rounded(chosen.select("model", "n", "accuracy", "f1_macro"), "accuracy", "f1_macro")


@query
def epoch_metrics(spark, sf_dir):
    events = A.table(spark, sf_dir, "events")
    k = F.col("event_id")
    batches = events.select(
        (F.col("user_id") % 4).alias("model"),
        F.floor(k / 500).cast("bigint").alias("epoch"),
        F.col("value").alias("loss"),
        (k % 32 + 1).alias("n"),
        F.greatest(k % 32 + 1 - k % 3, F.lit(0)).alias("n_correct"),
    )
    return rounded(E.epoch_metrics(batches), "loss", "accuracy")


PATIENCE = 5


@query
def early_stop(spark, sf_dir):
    stopped = HI.early_stop(A.epochs(spark, sf_dir), PATIENCE)
    return HI.training_summary(stopped)


# --- decisions, field test, history -----------------------------------------------------------

DECISION_MIN_VEG = 0.75


def decided(spark, sf_dir) -> DataFrame:
    fitted = spark.createDataFrame(
        [(m, t, 0.8) for m, t in FIXED_TEMPERATURES], "model string, temperature double, threshold double"
    )
    rows = A.scores2(spark, sf_dir).join(A.veg_shares(spark, sf_dir), "id")
    return D.decide(rows, fitted, min_vegetation=DECISION_MIN_VEG)


@query
def decide(spark, sf_dir):
    return rounded(
        decided(spark, sf_dir), "confidence", "healthy_prob", "anomalous_prob", "vegetation_fraction"
    )


@query
def decide_raw(spark, sf_dir):
    return rounded(
        D.decide_raw(A.scores2(spark, sf_dir)), "confidence", "healthy_prob", "anomalous_prob"
    )


@query
def decide_multiclass(spark, sf_dir):
    classes = [f"class_{k}" for k in range(10)]
    out = D.decide_multiclass(A.scores10(spark, sf_dir), classes, 0.5)
    return rounded(out.select("id", "predicted_class", "confidence", "accepted"), "confidence")


@query
def scores_json(spark, sf_dir):
    """Scores written as JSON text and read back: one row per class."""
    classes = [f"class_{k}" for k in range(10)]
    rows = D.decide_multiclass(A.scores10(spark, sf_dir), classes, 0.0)
    text = rows.select("id", F.to_json("scores").alias("scores_json"))
    back = text.select("id", F.explode(F.from_json("scores_json", "map<string,double>")).alias("class", "score"))
    return rounded(back, "score")


def field_rows(spark, sf_dir) -> DataFrame:
    truth = (
        F.when(F.col("toxic") == 1, "nao_folha").when(F.col("label_idx") == 1, "anomalous").otherwise("healthy")
    )
    truths = A.labelled_docs(spark, sf_dir).select("id", truth.alias("truth"))
    return decided(spark, sf_dir).join(truths, "id").select(
        "id", "model", "truth", F.col("label").alias("answer"), "confidence",
        E.hit_mark(F.col("truth"), F.col("label")).alias("hit"),
    )


@query
def field_marks(spark, sf_dir):
    return field_rows(spark, sf_dir).select("id", "model", "truth", "answer", "hit")


@query
def field_confusion(spark, sf_dir):
    return E.field_confusion(field_rows(spark, sf_dir))


@query
def field_test(spark, sf_dir):
    report = E.field_report(field_rows(spark, sf_dir))
    return rounded(report, "accuracy", "balanced_accuracy", "abstention_rate", "leaf_rejection_rate")


@query
def domain_gap(spark, sf_dir):
    """Validation rows as in-domain, test rows as the field."""
    rows = A.scores2(spark, sf_dir)
    known = E.headline(C.predictions(rows.filter("split = 'val'")))
    field = E.headline(C.predictions(rows.filter("split = 'test'")))
    return rounded(E.domain_gap(known, field), "in_domain", "field", "gap")


@query
def history_page(spark, sf_dir):
    rows = A.diagnoses(A.table(spark, sf_dir, "events"))
    return rounded(HI.history_page(rows, 50, 100), "confidence").drop("created_at")


@query
def history_delete(spark, sf_dir):
    rows = A.diagnoses(A.table(spark, sf_dir, "events"))
    gone = rows.filter("predicted_class = 'error' and confidence < 0.2").select("id")
    kept = HI.delete_diagnoses(rows, gone)
    return kept.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"))


@query
def history_delete_days(spark, sf_dir):
    """The same delete on a history in folders by day, which rewrites the touched days only."""
    rows = A.diagnoses(A.table(spark, sf_dir, "events"))
    path = new_path(spark, "history")
    FS.append_history(rows, path)
    FS.delete_history(spark, path, rows.filter("predicted_class = 'error' and confidence < 0.2").select("id"))
    kept = FS.read_history(spark, path)
    return kept.groupBy("day", "predicted_class").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("sum_id")).withColumn("day", F.col("day").cast("string"))


@query
def dashboard(spark, sf_dir):
    rows = A.diagnoses(A.table(spark, sf_dir, "events"))
    return rounded(HI.dashboard(rows), "mean_confidence_pct")


@query
def model_catalogue(spark, sf_dir):
    """Weights exist for the models that more than a quarter of the events name."""
    rows = A.diagnoses(A.table(spark, sf_dir, "events"))
    counts = rows.groupBy(F.col("model_name").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    ready = counts.withColumn("total", total).filter("n * 4 > total")
    return HI.model_catalogue(ready).select("model", "label", "has_weights", "n_ready")


@query
def evaluable_models(spark, sf_dir):
    """Score tables of models without weights are skipped: two of the three have some."""
    scored = A.scores2(spark, sf_dir)
    weights = scored.filter("model <> 'm_flat'").select("model")
    kept = HI.evaluable_models(scored, weights)
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query
def pixel_vegetation(spark, sf_dir):
    px = A.pixels(spark, sf_dir)
    green = S.excess_green(F.col("r"), F.col("g"), F.col("b")) > K.EXCESS_GREEN_CUT
    return rounded(px.groupBy("id").agg(F.avg(green.cast("double")).alias("vegetation")), "vegetation")


#: The class that ``fit_baseline_optimum`` tells from the others.
FIT_CLASS = 3


@query
def fit_baseline(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        F.col("label").cast("int").alias("label_idx"),
    )
    train = rows.filter("id % 2 = 0")
    weights = B.class_weights(train, "label_idx")
    model = D.fit_baseline(train, weights)
    scored = D.score_batch(rows, model).withColumn("held_out", F.expr("id % 2 = 1"))
    return scored.select("id", "label_idx", S.argmax(F.col("logits")).alias("pred"), "held_out")


@query
def fit_baseline_optimum(spark, sf_dir):
    """One class against the rest from two numbers of the vector, classes weighted, without a penalty: the fit's
    coefficients, and per class how many held-out rows it gets right."""
    rows = A.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.array(*[8 * F.col("embedding")[k].cast("double") for k in range(2)]).alias("features"),
        (F.col("label") == FIT_CLASS).cast("int").alias("label_idx"),
    )
    train = rows.filter("id % 2 = 0")
    model = D.fit_baseline(train, B.class_weights(train, "label_idx"), max_iter=200, reg=0.0, tol=1e-12)
    scored = D.score_batch(rows.filter("id % 2 = 1"), model)
    slopes, starts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    learned = {"b0": starts[1] - starts[0], "b1": slopes[1, 0] - slopes[0, 0], "b2": slopes[1, 1] - slopes[0, 1]}
    return scored.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("n_held_out"),
        F.count(F.when(S.argmax(F.col("logits")) == F.col("label_idx"), 1)).alias("n_right"),
        *[F.round(F.lit(float(value)), 4).alias(name) for name, value in learned.items()],
    )


@query
def fit_baseline_counts(spark, sf_dir):
    """Per class, how many held-out rows the fitted model scored and how many of them got a class."""
    scored = fit_baseline(spark, sf_dir).filter("held_out")
    return scored.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("n_scored"), F.count(F.when(F.col("pred") >= 0, 1)).alias("n_decided")
    )


@query
def image_hash(spark, sf_dir):
    """Texts as pictures, hashed pixel by pixel: the plain hash and the eight of the orbit."""
    rows = A.text_images(spark, sf_dir).withColumn("orbit", IM.orbit_of(F.col("image")))
    return rows.select(
        "id",
        IM.dhash_of(F.col("image")).alias("dhash"),
        *[F.col("orbit")[k].alias(f"h{k}") for k in range(8)],
    )


@query
def image_groups(spark, sf_dir):
    """Near-duplicate groups of those pictures, all eight orientations compared."""
    rows = A.text_images(spark, sf_dir).select("id", IM.orbit_of(F.col("image")).alias("orbit"))
    return G.near_dup_groups(store(rows), DOC_DISTANCE).select("id", "group_id")


@query
def image_vegetation(spark, sf_dir):
    rows = A.text_images(spark, sf_dir)
    return rounded(rows.select("id", IM.vegetation_of(F.col("image")).alias("vegetation")), "vegetation")


# --- streams ----------------------------------------------------------------------------------


@query
def stream_decide(spark, sf_dir):
    """Embeddings arriving as rows to decide on: two logits and a share from the vector itself."""
    stream = ST.read_table_stream(spark, sf_dir, "embeddings.parquet")
    out, progress = new_path(spark, "decisions"), new_path(spark, "decisions-progress")
    ST.decide_stream(A.vector_scores(stream), out, progress).awaitTermination()
    return rounded(
        spark.read.parquet(out).select("id", "label", "confidence", "vegetation_fraction"),
        "confidence",
        "vegetation_fraction",
    )


@query
def stream_hash(spark, sf_dir):
    """Embeddings arriving as grids to hash into an append-only store, run twice over."""
    store, progress = new_path(spark, "hashes"), new_path(spark, "hashes-progress")

    def hasher(batch: DataFrame) -> DataFrame:
        return batch.select("id", H.grid_orbit(F.col("embedding"), 8).alias("orbit"))

    for _ in range(2):
        stream = ST.read_table_stream(spark, sf_dir, "embeddings.parquet").select(
            F.col("vec_id").alias("id"), "embedding"
        )
        ST.hash_stream(stream, store, progress, hasher, key=("id",)).awaitTermination()
        progress = new_path(spark, "hashes-progress")
    rows = spark.read.parquet(store)
    return rows.select("id", *[F.col("orbit")[k].alias(f"h{k}") for k in range(8)])


@query
def stream_dashboard(spark, sf_dir):
    stream = A.diagnoses(ST.read_table_stream(spark, sf_dir, "events.parquet"))
    out, progress = new_path(spark, "dashboard"), new_path(spark, "dashboard-progress")
    ST.dashboard_stream(stream, out, progress).awaitTermination()
    return rounded(spark.read.parquet(out), "mean_confidence")


@query
def stream_dashboard_latest(spark, sf_dir):
    """The batch dashboard over what a stream of decisions holds as the latest ones."""
    stream = A.diagnoses(ST.read_table_stream(spark, sf_dir, "events.parquet"))
    out, progress = new_path(spark, "latest"), new_path(spark, "latest-progress")
    ST.latest_stream(stream, out, progress, K.HISTORY_MAX_LIMIT).awaitTermination()
    return rounded(HI.dashboard(ST.read_latest(spark, out)), "mean_confidence_pct")
