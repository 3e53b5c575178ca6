"""End-to-end plans (survey section 3), as functions over DataFrames.

* ``semantic_id_counts``  - the minimum slice: features -> M1 -> M3 -> M4 -> M11 -> A10 input.
* ``build_feature_table`` - tags x documents -> catalog features (stages 1-4 of the full run).
* ``run_full``            - three-category program: features, PCA, dictionary IDs, training sets.
* ``run_two_tags``        - genre + instrument program with the selected feature set.
* ``run_discrimination``  - feature discrimination report.

Stage hand-offs are stored tables (S10 ``materialize``), so every stage can be
re-run alone and lineage is cut between stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import FeatureSet, all_leaves, preset
from ..functions.ids import codes_to_id
from ..functions.json_leaf import Leaves, parse
from ..functions.tags import is_tagged, n_tagged
from ..operators import discriminate, idstats, linalg, recsets, rvq
from ..operators import tags as TG
from ..operators.dictlearn import fit_dictionary
from ..sources import store
from ..sources.documents import json_name, parsed_documents, read_documents, shred
from ..sources.tags import read_tag_tsv
from .inputs import embeddings


def semantic_id_counts(spark: SparkSession, sf_dir: str, ratio: float = 0.80, n_levels: int = 2,
                       n_clusters: int = 8, max_iter: int = 20) -> DataFrame:
    """Flagship query: ``(semantic_id, n)`` rows per RVQ semantic ID of the embeddings."""
    z, _ = linalg.standardize(embeddings(spark, sf_dir))
    pca = linalg.fit_pca(z, ratio=ratio)
    scores = pca.transform(z).select("vec_id", F.col("pca").alias("features"))
    _, codes, _ = rvq.fit_rvq(scores, n_levels, n_clusters, max_iter, 1)
    ids = codes.select(codes_to_id("codes").alias("semantic_id"))
    return idstats.id_counts(ids)


def load_tags(spark: SparkSession, paths: dict[str, str], how: str = "outer",
              multi_tag: str = "drop", header: str | None = None, watch: store.Watch | None = None) -> DataFrame:
    """Stages 1-2: read each category file (S1) and merge (J1 outer / J2 inner)."""
    tables = {cat: read_tag_tsv(spark, p, cat, multi_tag, header, watch) for cat, p in paths.items()}
    if how == "outer":
        return TG.merge_outer(tables)
    cats = list(tables)
    out = tables[cats[0]]
    for c in cats[1:]:
        out = TG.merge_inner(out, tables[c])
    return out


def store_documents(spark: SparkSession, doc_root: str, path: str, doc_format: str = "files") -> None:
    """Parse every document once into the shredded layout at ``path``: a typed column for each leaf of any feature set, beside
    the document itself."""
    shred(parsed_documents(spark, doc_root, doc_format), path, all_leaves())


def build_feature_table(spark: SparkSession, tags: DataFrame, doc_root: str,
                        features: FeatureSet, strategy: str = "extract_first", doc_format: str = "files",
                        watch: store.Watch | None = None) -> DataFrame:
    """Stage 3: tags joined to their documents (J5), catalog projection in one select.

    ``json_full`` records the document's relative name.  How documents meet tags, the same
    at every size (whether a side is broadcast is left to adaptive execution):

    * ``extract_first`` - every document is parsed and projected map-side, and the
      compact feature rows (not the raw JSON text) meet the tags.  Documents in the shredded
      layout (``doc_format="shredded"``) are read by the leaves of the feature set only.
    * ``shuffle`` - documents and tags meet by path first and only matched documents are
      parsed; with ``spark.sql.optimizer.runtime.bloomFilter.enabled`` Spark prunes
      unmatched documents before the shuffle, so this is the better choice when only a
      small share of a large document dump has tags.

    With ``watch`` the job that computes the table also counts the tag rows that want a document, the documents and the
    malformed ones, the rows found, those without any feature (P17), and the missing values of the others (P18).

    The result carries no filter on purpose: a filter on document columns would be
    pushed onto the document scan.  Apply ``drop_empty_records`` (P17) to the stored
    table; a malformed document parses to null and so has only null features.
    """
    keep = [c for c in tags.columns]
    see = watch.on if watch is not None else lambda df, stage, **metrics: df
    keyed = see(tags.withColumn("rel_path", json_name("path")), "wanted", n_rows=F.count(F.lit(1)))
    malformed = F.col("doc").isNull() if doc_format != "shredded" else F.col("malformed")
    if doc_format == "shredded":
        docs = spark.read.parquet(doc_root)
        docs = docs.select("rel_path", "malformed", *features.leaves()) if strategy == "extract_first" else docs
    elif strategy == "extract_first":
        docs = parsed_documents(spark, doc_root, doc_format)
    elif doc_format == "files":
        docs = read_documents(spark, doc_root)
        malformed = parse("text").isNull()
    else:
        docs = parsed_documents(spark, doc_root, doc_format)
    docs = see(docs, "documents", n_rows=F.count(F.lit(1)), n_malformed=F.count_if(malformed))
    vector = features.vector(Leaves() if doc_format == "shredded" else F.col("doc")).alias("features")
    if strategy == "extract_first":
        out = keyed.join(docs.select("rel_path", vector), "rel_path").select(*keep, F.col("rel_path").alias("json_full"), "features")
    elif strategy == "shuffle":
        joined = keyed.join(docs, "rel_path")
        if doc_format == "files":
            joined = joined.withColumn("doc", parse("text")).drop("text")
        out = joined.select(*keep, F.col("rel_path").alias("json_full"), vector)
    else:
        raise ValueError("strategy must be extract_first or shuffle")
    empty = F.array_max("features").isNull()
    missing = F.aggregate("features", F.lit(0), lambda n, v: n + F.when(v.isNull() | F.isnan(v), 1).otherwise(0))
    return see(out, "found", n_rows=F.count(F.lit(1)), n_empty=F.count_if(empty), n_filled=F.sum(F.when(~empty, missing)))


def missing_leaf_counts(df: DataFrame, names: list[str], col: str = "features") -> DataFrame:
    """Per catalog feature, how many records lack it (one aggregation, d rows out)."""
    names_arr = F.array(*[F.lit(n) for n in names])
    long = df.select(F.posexplode(col).alias("idx", "v"))
    per = long.groupBy("idx").agg(F.count_if(F.col("v").isNull() | F.isnan("v")).alias("n_missing"),
                                  F.count("*").alias("n_records"))
    return per.select(F.get(names_arr, F.col("idx")).alias("feature"), "n_missing", "n_records")


def extra_leaf_counts(docs: DataFrame, features: FeatureSet) -> DataFrame:
    """Per array leaf of the feature set the documents (column ``doc``) with more elements than its declared width, and how many
    elements the catalog leaves out, in one aggregation: ``(leaf, n_documents, n_extra)``."""
    extra = features.extra_elements(F.col("doc"))
    per = F.array(*[F.struct(F.lit(path).alias("leaf"), n.alias("n")) for path, n in extra.items()])
    each = docs.select(F.explode(per).alias("x"))
    return each.groupBy(F.col("x.leaf").alias("leaf")).agg(F.count_if(F.col("x.n") > 0).alias("n_documents"),
                                                           F.coalesce(F.sum("x.n"), F.lit(0)).cast("long").alias("n_extra"))


def assert_widths(docs: DataFrame, features: FeatureSet) -> None:
    """P7 strict mode: raise if any document has elements beyond a declared width (names the first such leaf)."""
    bad = extra_leaf_counts(docs, features).filter(F.col("n_extra") > 0).orderBy("leaf").limit(1).collect()
    if bad:
        raise ValueError(f"leaf {bad[0]['leaf']!r} is wider than declared in {bad[0]['n_documents']} documents")


def assert_complete(df: DataFrame, names: list[str], col: str = "features") -> None:
    """D4 strict mode: raise if any record lacks any catalog feature (names the first one)."""
    bad = missing_leaf_counts(df, names, col).filter(F.col("n_missing") > 0).orderBy("feature").limit(1).collect()
    if bad:
        raise ValueError(f"feature {bad[0]['feature']!r} missing in {bad[0]['n_missing']} records")


def drop_empty_records(df: DataFrame, col: str = "features") -> DataFrame:
    """A record without any extracted feature is no record.

    ``array_max`` skips nulls, so it is null exactly when every feature is null; unlike
    ``exists`` (a higher-order function, evaluated interpreted) it stays code-generated
    even when Catalyst inlines the feature projection into the filter."""
    return df.filter(F.array_max(col).isNotNull())


def _scores_and_ids(spark: SparkSession, out: str, suffix: str, feats: DataFrame, cats: list[str], made: dict,
                    rebuild: bool, ratio: float, n_atoms: int | None, n_nonzero: int, max_iter: int,
                    batch_size: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages 4-7: PCA scores, explained variance and semantic IDs, each stored with the parameters
    that made it.  A stage is reused, and its model not refitted, only under the same parameters, those
    of the stages before included.  ``n_atoms`` None: at most 16, as many as components."""
    made = {**made, "ratio": ratio}
    if rebuild or not store.is_current(spark, f"{out}/features_pca{suffix}", made):
        filled, _ = discriminate.fill_missing(feats)
        z, _ = linalg.standardize(filled)
        pca = linalg.fit_pca(z, ratio=ratio)
        store.write_table(pca.variance_table(spark), f"{out}/explained_variance{suffix}")  # S8
        store.materialize(spark, f"{out}/features_pca{suffix}", lambda: pca.transform(z).select(
            "track_id", "path", *cats, F.col("pca").alias("features")), rebuild=True, made=made)
    scores = store.read_table(spark, f"{out}/features_pca{suffix}")
    variance = store.read_table(spark, f"{out}/explained_variance{suffix}")
    made = {**made, "atoms": n_atoms, "nonzero": n_nonzero, "max_iter": max_iter, "batch": batch_size, "seed": seed}
    if rebuild or not store.is_current(spark, f"{out}/dataset_with_semantic_ids{suffix}", made):
        if n_atoms is None:
            n_atoms = min(16, variance.count())
        model = fit_dictionary(scores, n_atoms, n_nonzero, max_iter, batch_size, seed=seed, id_col="track_id")
        store.save_model(spark, out, f"dictionary{suffix}", model.tables(spark))
        ids = model.transform(scores).withColumn("semantic_id", codes_to_id("codes"))
        stored = store.materialize(spark, f"{out}/dataset_with_semantic_ids{suffix}", lambda: ids, rebuild=True, made=made)
        store.write_csv(stored.select("track_id", "path", *cats, "codes", "semantic_id"), f"{out}/dataset_with_semantic_ids{suffix}_csv")  # S6
    return scores, variance, store.read_table(spark, f"{out}/dataset_with_semantic_ids{suffix}")


def _stored_split(spark: SparkSession, out: str, suffix: str, pairs: DataFrame, seed: int, group_split: bool = False) -> DataFrame:
    """The split training pairs, stored, and each split as CSV."""
    path = f"{out}/training_pairs{suffix}"
    store.write_table(recsets.split_by_group(pairs, "track_id", seed) if group_split
                      else recsets.split_exact(pairs, F.concat_ws(":", "track_id", "rep"), seed), path)
    stored = store.read_table(spark, path)
    store.write_splits(stored, f"{out}/training{suffix}")
    return stored


def _feature_stage(spark: SparkSession, path: str, tag_paths: dict[str, str], cats: list[str], least: int, doc_root: str, fs: FeatureSet,
                   made: dict, rebuild: bool, doc_format: str, tag_header: str | None, how: str = "outer") -> tuple[DataFrame, DataFrame]:
    """Stages 1-3 in one job: tags read and merged, rows with at least ``least`` tags kept (W1-W4), their documents' features stored at
    ``path`` and, as CSV with a column for each feature, at ``path_csv`` (S6).  Returns the records with features (P17) and the
    counts that the job took (S2, A1-A3, P17, P18), ``(stage, metric, value)``."""
    def build(watch: store.Watch) -> DataFrame:
        merged = load_tags(spark, {c: tag_paths[c] for c in cats}, how=how, header=tag_header, watch=watch)
        kept = n_tagged(cats) >= least
        merged = watch.on(merged, "merged", n_rows=F.count(F.lit(1)), n_kept=F.count_if(kept), **{
            f"n_{c}": F.count_if(is_tagged(c)) for c in cats}, **{f"kept_{c}": F.count_if(kept & is_tagged(c)) for c in cats})
        return build_feature_table(spark, merged.filter(kept), doc_root, fs, doc_format=doc_format, watch=watch)
    written = rebuild or not store.is_current(spark, path, made)
    stored, observed = store.materialize_watched(spark, path, build, rebuild=rebuild, made=made)
    feats = drop_empty_records(stored)
    if written:
        store.write_csv(store.widen(feats, fs.names), f"{path}_csv")
    TG.assert_unique(feats, ["path"], "feature table")  # A4
    return feats, observed


def observed_reports(observed: DataFrame, cats: list[str]) -> dict[str, DataFrame]:
    """A1, A2 and A3 as tables, from the counts of the feature stage: no row is read for them."""
    def pick(stage: str, metric: str) -> Column:
        return F.max(F.when((F.col("stage") == stage) & (F.col("metric") == metric), F.col("value")))
    one = observed.agg(pick("merged", "n_rows").alias("n_total"), pick("merged", "n_kept").alias("n_kept"), pick("wanted", "n_rows").alias("n_wanted"),
                       pick("found", "n_rows").alias("n_found"), *[pick("merged", f"n_{c}").alias(f"all_{c}") for c in cats],
                       *[pick("merged", f"kept_{c}").alias(f"{c}_tagged") for c in cats])
    share = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"all_{c}").alias("n_tagged")) for c in cats])).alias("x")
    return {"document_coverage": one.select(F.col("n_wanted").alias("n_rows"), "n_found", share("n_found", "n_wanted").alias("coverage_pct")),
            "tag_coverage": one.select("n_total", per).select("x.category", F.col("n_total").alias("n_rows"), "x.n_tagged",
                                                              F.try_divide(F.col("x.n_tagged") * 100.0, "n_total").alias("pct")),
            "retention": one.select("n_total", "n_kept", share("n_kept", "n_total").alias("pct_kept"), *[f"{c}_tagged" for c in cats])}


def run_full(spark: SparkSession, tag_paths: dict[str, str], doc_root: str, out_dir: str,
             ratio: float = 0.80, n_atoms: int = 16, n_nonzero: int = 2, max_iter: int = 200,
             batch_size: int | None = 256, threshold: int = 16, max_replication: int = 6,
             seed: int = 42, rebuild: bool = False, doc_format: str = "files",
             tag_header: str | None = None, group_split: bool = False) -> dict[str, DataFrame]:
    """Three-category program (stages 1-8 of the full run).  ``group_split`` keeps the copies of a track in one split."""
    out, cats, fs = out_dir.rstrip("/"), ["genre", "mood", "instrument"], preset("full_run")
    made = {"tags": tag_paths, "header": tag_header, "documents": doc_root, "format": doc_format, "features": fs.names}
    feats, observed = _feature_stage(spark, f"{out}/features", tag_paths, cats, 2, doc_root, fs, made, rebuild, doc_format, tag_header)
    scores, variance, ids = _scores_and_ids(
        spark, out, "", feats, cats, made, rebuild, ratio, n_atoms, n_nonzero, max_iter,
        batch_size, seed)
    pairs = recsets.training_pairs(ids, "track_id", "semantic_id", threshold, max_replication, seed)
    split = _stored_split(spark, out, "", pairs, seed, group_split)
    return {"features": feats, "scores": scores, "ids": ids, "pairs": split, "observed": observed,
            "variance": variance, "occupancy": idstats.occupancy(ids), **observed_reports(observed, cats),
            **tag_profiles(load_tags(spark, {c: tag_paths[c] for c in cats}, header=tag_header), cats),
            "id_detail": idstats.occupancy_detail(ids), "top_ids": idstats.top_ids(ids, 10),
            "missing_leaves": missing_leaf_counts(feats, fs.names)}


def tag_profiles(merged: DataFrame, cols: list[str], top: int = 20) -> dict[str, DataFrame]:
    """The reports along the reference's feature stage that need groups of the tag rows, as tables: A5 category counts,
    A6 top tags per category."""
    tops = [TG.top_counts(merged, c, top).withColumn("category", F.lit(c)) for c in cols]
    return {"category_counts": TG.category_counts(merged, cols), "top_tags": reduce(lambda a, b: a.unionByName(b), tops)}


def run_two_tags(spark: SparkSession, tag_paths: dict[str, str], doc_root: str, out_dir: str,
                 ratio: float = 0.85, max_iter: int = 200, batch_size: int | None = 256,
                 threshold: int = 16, max_replication: int = 8, seed: int = 42,
                 rebuild: bool = False, doc_format: str = "files",
                 tag_header: str | None = None) -> dict[str, DataFrame]:
    """Genre + instrument program: inner merge (J2), selected features, both tags."""
    out = out_dir.rstrip("/")
    cats, fs = ["genre", "instrument"], preset("selected")
    made = {"tags": {k: tag_paths[k] for k in cats}, "header": tag_header, "documents": doc_root, "format": doc_format,
            "features": fs.names}
    feats, observed = _feature_stage(spark, f"{out}/features_nomood", tag_paths, cats, 2, doc_root, fs, made, rebuild, doc_format, tag_header,
                                     how="inner")
    scores, variance, ids = _scores_and_ids(spark, out, "_nomood", feats, cats, made, rebuild, ratio, None, 2, max_iter,
                                            batch_size, seed)
    pairs = recsets.training_pairs(ids, "track_id", "semantic_id", threshold, max_replication, seed,
                                   two_tags=True)
    return {"features": feats, "scores": scores, "variance": variance, "ids": ids, "pairs": _stored_split(spark, out, "_nomood", pairs, seed),
        "occupancy": idstats.occupancy(ids), "id_detail": idstats.occupancy_detail(ids), "top_ids": idstats.top_ids(ids, 10),
        "observed": observed, **observed_reports(observed, cats),
        **tag_profiles(load_tags(spark, {c: tag_paths[c] for c in cats}, how="inner", header=tag_header), cats),
        "missing_leaves": missing_leaf_counts(feats, fs.names)}


def run_discrimination(spark: SparkSession, tag_paths: dict[str, str], doc_root: str, out_dir: str,
                       top_n: int = 10, always_include: dict[str, str] | None = None,
                       feature_set: str = "all", rebuild: bool = False, doc_format: str = "files",
                       tag_header: str | None = None) -> dict[str, DataFrame]:
    """Feature discrimination report over tracks with at least one tag (W3/W4): the results, stored and as CSV per category, and the inputs
    of the plots: values of the top-6 pairs (T5), values, quartiles and outlines of the top-6 features by tag (T9).

    The feature table is stored first (S10, as the reference caches its feature
    CSV): the wide catalog projection is planned once, and the report reads it back.
    """
    fs, root, cats = preset(feature_set), out_dir.rstrip("/"), ["genre", "mood", "instrument"]
    made = {"tags": tag_paths, "header": tag_header, "documents": doc_root, "format": doc_format, "features": fs.names}
    feats, observed = _feature_stage(spark, f"{root}/features_{feature_set}", tag_paths, cats, 1, doc_root, fs, made, rebuild, doc_format,
                                     tag_header)
    tags = feats.select("track_id", "genre", "mood", "instrument")
    res = discriminate.discrimination(feats, tags, fs.names, ["genre", "mood", "instrument"], "track_id",
                                      "features", top_n, always_include if always_include is not None
                                      else {"mood": "sad"})
    always = always_include if always_include is not None else {"mood": "sad"}
    labels, top = discriminate.single_top_labels(tags, ["genre", "mood", "instrument"], "track_id", top_n, always)
    res = store.materialize(spark, f"{root}/discrimination", lambda: res, rebuild=True)
    summary = discriminate.discrimination_summary(res)
    for c in cats:  # S6: a result file for each category, and the summary
        store.write_csv(res.filter(F.col("category") == c).orderBy("rank"), f"{root}/discrimination_{c}_csv")
    store.write_csv(summary, f"{root}/discrimination_summary_csv")
    violins = discriminate.top_feature_values(feats, labels, fs.names, res, 6)
    groups = ["category", "feature", "label"]
    out = {"discrimination": res, "summary": summary, "observed": observed, **observed_reports(observed, cats),
           "pairs": discriminate.feature_pairs(res, ["category"], 6), "top_tags": top,
           "pair_values": discriminate.top_pair_values(feats, labels, fs.names, res, 6), "violin_values": violins,
           "violin_quantiles": discriminate.value_quantiles(violins, groups), "violin_density": discriminate.value_density(violins, groups)}
    cv = discriminate.contrast_valley_pairs(fs.names)
    if cv:  # T9-style plot inputs
        out["contrast_valley"] = discriminate.pair_values(feats, labels, fs.names, cv)
    if "key_vector_x" in fs.names:
        out["tonal"] = discriminate.tonal_vectors(feats, labels, fs.names)
    return out


def rvq_semantic_ids(df: DataFrame, out_dir: str | None = None, name: str = "best_kmeans",
                     n_levels: int = 2, n_clusters: int = 128, max_iter: int = 200, n_init: int = 16,
                     seed: int = 42, col: str = "features"):
    """Fit RVQ, attach semantic IDs, report occupancy, persist the codebook.

    Returns ``(ids, occupancy, codebook)``; ``name`` keeps stored tables of
    different runs apart (D14)."""
    book, codes, _ = rvq.fit_rvq(df, n_levels, n_clusters, max_iter, n_init, seed, col)
    ids = codes.withColumn("semantic_id", codes_to_id("codes"))
    if out_dir:
        store.save_model(df.sparkSession, out_dir, name, {"codebook": book})
    return ids, idstats.occupancy(ids), book


def load_rvq_ids(df: DataFrame, out_dir: str, name: str = "best_kmeans", col: str = "features") -> DataFrame:
    """M5 via stored tables: missing model raises FileNotFoundError."""
    book = store.load_model(df.sparkSession, out_dir, name, ["codebook"])["codebook"]
    return rvq.apply_rvq(df, book, col).withColumn("semantic_id", codes_to_id("codes"))


def dictionary_semantic_ids(df: DataFrame, out_dir: str | None = None, name: str = "best_dl",
                            n_nonzero: int = 2, n_atoms: int = 128, max_iter: int = 100,
                            batch_size: int | None = 256, seed: int = 42, col: str = "features",
                            id_col: str | None = None):
    """Fit the dictionary, attach semantic IDs, report occupancy, persist
    dictionary and config tables (S9)."""
    model = fit_dictionary(df, n_atoms, n_nonzero, max_iter, batch_size, seed=seed, col=col, id_col=id_col)
    ids = model.transform(df, col).withColumn("semantic_id", codes_to_id("codes"))
    if out_dir:
        store.save_model(df.sparkSession, out_dir, name, model.tables(df.sparkSession))
    return ids, idstats.occupancy(ids), model


def load_dictionary_ids(df: DataFrame, out_dir: str, name: str = "best_dl", col: str = "features") -> DataFrame:
    """M10 via stored tables: missing model raises FileNotFoundError."""
    from ..operators.dictlearn import load_dictionary
    tables = store.load_model(df.sparkSession, out_dir, name, ["dictionary", "config"])
    return load_dictionary(tables).transform(df, col).withColumn("semantic_id", codes_to_id("codes"))


def run_semantic_ids(spark: SparkSession, scores: DataFrame, out_dir: str, method: str = "dictionary",
                     id_col: str = "track_id", tag_cols: list[str] | None = None, k: int = 20,
                     search: dict | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The semantic-ID program: grid search (M14 or M15), persist the best model (S9),
    IDs for every row (M5/M10 + M11), statistics (A11) and quality per tag column (A13)."""
    from .search import search_dictionary, search_rvq
    search = dict(search or {})
    out = out_dir.rstrip("/")
    if method == "rvq":
        results, book = search_rvq(scores, id_col=id_col, seed=seed, **search)
        store.save_model(spark, out, "best_kmeans", {"codebook": book})
        ids = rvq.apply_rvq(scores, book)
    elif method == "dictionary":
        results, model = search_dictionary(scores, id_col=id_col, seed=seed, **search)
        store.save_model(spark, out, "best_dl", model.tables(spark))
        ids = model.transform(scores)
    else:
        raise ValueError("method must be rvq or dictionary")
    ids = store.materialize(spark, f"{out}/dataset_with_semantic_ids",
                            lambda: ids.withColumn("semantic_id", codes_to_id("codes")), rebuild=True)
    res = {"search": results, "ids": ids, "id_detail": idstats.occupancy_detail(ids),
           "top_ids": idstats.top_ids(ids, 10)}
    if tag_cols:
        from ..operators.quality import quality_report
        res["quality"] = quality_report(ids, tag_cols, "semantic_id", id_col, "features", k)
    return res
