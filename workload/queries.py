"""The registered queries: name to a function of (spark, table folder)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundsieve.config import DEFAULT_EXPANSIONS, RetrievalConfig
from groundsieve.functions.outputs import ANSWER, REPORT
from groundsieve.functions.text import (
    infer_passage_strategy, lexical_tokens, normalize_question, normalize_text, token_count,
)
from groundsieve.functions.vectors import l2_normalize
from groundsieve.operators import answers as ans, evaluation as ev, prompts
from groundsieve.operators.cells import build_cells, cell_search, read_cells, write_cells
from groundsieve.operators.dense import dense_search, embed_questions, hash_embedding
from groundsieve.operators.evidence import bundle_anchors, context_from_places, context_from_windows, expand_context
from groundsieve.operators.fusion import count_broken_scores, rerank, score_pairs_in_batches
from groundsieve.operators.lexical import bm25_search, prepare_questions
from groundsieve.operators.postings import block_search, read_postings, write_postings
from groundsieve.operators.outputs import check_outputs, latest, resolve_attempts
from groundsieve.operators.splitting import (
    context_windows, passages_table, sections_table, split_documents, windows_table,
)
from groundsieve.plans.answering import Answers, answer
from groundsieve.plans.evaluation import model_run, run_eval, sweep, sweep_results
from groundsieve.plans.ingest import ingest, ingest_once
from groundsieve.plans.retrieval import debug_record
from groundsieve.plans.segments import compact_segments, create_segments, open_segments, update_segments
from groundsieve.sources.corpus import parse_units, with_chapter_boundaries
from groundsieve.sources.places import store_places
from groundsieve.sources.rejects import check_eval_items, check_units
from groundsieve.sources.staging import new_folder, spread
from groundsieve.sources.tables import (
    load_documents, load_index, read_artifact, read_candidates, read_results, save_artifact, save_candidates, save_index, save_projects, save_results,
)
from workload.data import (
    documents, eval_items, found, pair_scores, prepared, questions, quotes, table,
)

SETTINGS = {
    "balanced": RetrievalConfig(),
    "boosted": RetrievalConfig(overlap_boost_enabled=True),
    "dense_heavy": RetrievalConfig(hybrid_alpha=0.3, hybrid_beta=0.7),
    "lexical_heavy": RetrievalConfig(hybrid_alpha=0.7, hybrid_beta=0.3),
    "no_reranker": RetrievalConfig(reranker_enabled=False),
    "short_rerank": RetrievalConfig(reranker_top_k=10),
}


def _messy(text: Column) -> Column:
    """The text with tabs, carriage returns, piled-up empty lines and split accents."""
    out = F.replace(text, F.lit(", "), F.lit(" ,\t  "))
    out = F.replace(out, F.lit("\n"), F.lit(" \r\n\r\n \n\n"))
    out = F.replace(out, F.lit("\u00e9"), F.lit("e\u0301"))
    return F.concat(F.lit(" \n\t"), out, F.lit("\n \n"))


def _spaced(text: Column) -> Column:
    """Every line a paragraph of its own."""
    return F.replace(text, F.lit("\n"), F.lit("\n\n"))


def _headed(text: Column) -> Column:
    """Lines that start with A, E or T become headings."""
    return F.regexp_replace(text, r"(?m)^(?=[AET])", "# ")


def _unit_text(text: Column) -> Column:
    """Lines as chapter|unit|text, three units to a chapter; every fifth line stays bare."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda l, n: F.when(
        n % 5 == 4, l).otherwise(F.concat(
            (F.floor(n / 3) + 1).cast("string"), F.lit("|"), (n + 1).cast("string"), F.lit("|"), l))),
        "\n")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def q_normalize_text(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", normalize_text(_messy(F.col("text"))).alias("normalized_text"))


def q_normalize_question(spark, folder):
    rows = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", normalize_question(_messy(F.col("text"))).alias("question"))


def q_tokenize_stem(spark, folder):
    rows = _docs(spark, folder).withColumn("tokens", lexical_tokens(F.col("text")))
    return rows.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
        token_count(F.col("text")).cast("bigint").alias("n_words"))


def q_tokenize_stem_compat(spark, folder):
    tokens = lexical_tokens(F.col("text"), compat=True)
    return _docs(spark, folder).select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def q_query_expansion(spark, folder):
    """Every question with two themes of the expansion table put before it."""
    names = F.array(*[F.lit(k) for k in sorted(DEFAULT_EXPANSIONS)])
    n = F.col("query_id").cast("int")
    asked = questions(spark, folder).withColumn("question", F.concat(
        F.lit("What does the text say about "), F.get(names, n % 10), F.lit(" and "),
        F.get(names, (n + 3) % 10), F.lit("? "), "question"))
    rows = prepare_questions(asked, dict(DEFAULT_EXPANSIONS))
    return rows.select("query_id", F.array_join("expanded_terms", " ").alias("expanded_terms"),
                       "lexical_query")


def q_infer_strategy(spark, folder):
    text = F.col("text")
    return _docs(spark, folder).select(
        "doc_id", infer_passage_strategy(text).alias("strategy"),
        infer_passage_strategy(_spaced(text)).alias("spaced_strategy"))


def _sections(split: DataFrame) -> DataFrame:
    return sections_table(split).select(
        "document_id", "section_id", "section_type", "title", "order_index", "start_offset",
        "end_offset")


def _passages(split: DataFrame) -> DataFrame:
    return passages_table(split).select(
        "document_id", "section_id", "passage_id", "passage_index", "text", "start_offset",
        "end_offset", "token_count")


def q_sections_paragraph(spark, folder):
    return _sections(split_documents(documents(spark, folder, _spaced(F.col("text")))))


def q_sections_heading(spark, folder):
    return _sections(split_documents(
        documents(spark, folder, _headed(F.col("text")), sectioning="heading")))


def _chaptered(spark, folder):
    return with_chapter_boundaries(
        documents(spark, folder, _unit_text(F.col("text")), sectioning="explicit"))


def q_sections_explicit(spark, folder):
    return _sections(split_documents(_chaptered(spark, folder)))


def q_unit_lines(spark, folder):
    return parse_units(documents(spark, folder, _unit_text(F.col("text"))))


def q_passages_lines(spark, folder):
    return _passages(split_documents(documents(spark, folder)))


def q_passages_paragraphs(spark, folder):
    return _passages(split_documents(
        documents(spark, folder, _spaced(F.col("text")), passages="paragraph")))


def q_passages_sentences(spark, folder):
    return _passages(split_documents(documents(spark, folder, passages="sentence_group")))


def q_passages_explicit(spark, folder):
    return _passages(split_documents(_chaptered(spark, folder)))


def _windows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "document_id", "anchor_passage_id", "start_passage_index", "end_passage_index",
        F.array_join("included_passage_ids", " ").alias("included_passage_ids"), "text")


def q_passage_windows(spark, folder):
    return _windows(windows_table(split_documents(documents(spark, folder)), radius=1))


def q_passage_windows_nested(spark, folder):
    """The same windows, read from split documents that were written once."""
    return _windows(ingest_once(documents(spark, folder)).windows)


def q_passage_windows_gaps(spark, folder):
    """Windows over the passages that hold ten words or more, so places are missing."""
    passages = prepared(spark, folder).index.passages.where("token_count >= 10")
    rows = _windows(context_windows(passages, radius=2))
    return rows.withColumns({c: F.col(c).cast("int") for c in
                             ("start_passage_index", "end_passage_index")})


def q_bm25_stats(spark, folder):
    stats = prepared(spark, folder).index.lexical.corpus_stats
    return stats.select("n_passages", F.round("mean_length", 6).alias("mean_length"),
                        F.round("mean_idf", 6).alias("mean_idf"))


def q_bm25_postings(spark, folder):
    """Per term the passages and occurrences of the whole index."""
    postings = prepared(spark, folder).index.lexical.postings
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"),
        F.sum("length").alias("total_length"))


def q_bm25_topk(spark, folder):
    base = prepared(spark, folder)
    rows = bm25_search(base.index.lexical, prepare_questions(base.questions), 10)
    return rows.select("query_id", "passage_id", "lexical_score", "rank_lexical")


def q_bm25_topk_blocks(spark, folder):
    """The same search over a stored index that skips blocks."""
    base = prepared(spark, folder)
    path = new_folder(spark, "postings")
    write_postings(base.index.lexical, path)
    return block_search(read_postings(spark, path), prepare_questions(base.questions), 10).hits


def q_bm25_topk_segments(spark, folder):
    """The same search over a store that came to hold all documents by changes: it starts without
    some, with a wrong text of others, and with some twice."""
    docs, path, n = documents(spark, folder), new_folder(spark, "segments"), F.col("document_id").cast("int") % 10
    old = docs.where(n != 3).withColumn("text", F.when(n == 5, F.reverse("text")).otherwise(F.col("text")))
    twice = docs.where(n == 7).withColumn("document_id", F.concat(F.lit("copy-"), "document_id"))
    create_segments(old.unionByName(twice), path)
    update_segments(path, docs.where(n == 3), twice)
    compact_segments(spark, path)
    update_segments(path, docs.where(n == 5))
    index = open_segments(spark, path)
    return bm25_search(index.lexical, prepare_questions(questions(spark, folder)), 10).select(
        "query_id", "passage_id", "lexical_score", "rank_lexical")


def q_bm25_topk_compat(spark, folder):
    base = prepared(spark, folder, compat=True)
    asked = prepare_questions(base.questions, compat=True)
    rows = bm25_search(base.index.lexical, asked, 30, compat=True)
    return rows.select("query_id", "passage_id", "lexical_score", "rank_lexical")


def q_hash_embed(spark, folder):
    rows = hash_embedding(prepared(spark, folder).index.vectors)
    return rows.select("passage_id", F.col("dim").cast("int").alias("dim"),
                       F.round("weight", 6).alias("weight"))


def q_dense_topk_hash(spark, folder):
    base = prepared(spark, folder)
    asked = embed_questions(prepare_questions(base.questions))
    return dense_search(base.index.vectors, asked, 10)


def q_l2_normalize(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dim", "x")).select(
        "vec_id", "dim", F.round("x", 6).alias("value"))


def q_dense_topk_vectors(spark, folder):
    """The vectors nearest to the mean vector of each label."""
    rows = table(spark, folder, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("string").alias("passage_id"),
                          F.col("embedding").alias("vector"))
    return dense_search(vectors, _centres(rows), 10, dims=64, hashed=False)


def q_dense_topk_cells(spark, folder):
    """The same from a stored index of cells, those that cannot reach the k-th score left out."""
    rows = table(spark, folder, "embeddings")
    path = new_folder(spark, "cells")
    write_cells(build_cells(rows.select(F.col("vec_id").cast("string").alias("passage_id"),
                                        F.col("embedding").alias("vector")), 64), path)
    return cell_search(read_cells(spark, path), _centres(rows), 10).hits


def _centres(rows: DataFrame) -> DataFrame:
    parts = rows.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy(
        "label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select(
        F.col("label").cast("string").alias("query_id"), F.col("p.x").alias("vector"))


def q_dense_topk_broken(spark, folder):
    """The same search where some vectors hold a NaN or are missing."""
    rows = table(spark, folder, "embeddings")
    centres = _centres(rows)
    broken = F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))
    vectors = rows.select(
        F.col("vec_id").cast("string").alias("passage_id"),
        F.when(F.col("vec_id") % 11 == 5, F.lit(None)).when(F.col("vec_id") % 7 == 3, broken)
        .otherwise(F.col("embedding")).alias("vector"))
    return dense_search(vectors, centres, 10, dims=64, hashed=False)


_CANDIDATE = ["query_id", "passage_id", "lexical_score", "dense_score",
              "lexical_score_normalized", "dense_score_normalized", "overlap_matched",
              "overlap_boost", "hybrid_score", "rank_hybrid"]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in
                             ("lexical_score_normalized", "dense_score_normalized")})


def q_hybrid_fusion(spark, folder):
    rows = found(spark, folder).merged.withColumn(
        "source_methods", F.array_join("source_methods", "+"))
    return _rounded(rows).select(*_CANDIDATE, "source_methods")


def q_overlap_boost(spark, folder):
    fused, _ = sweep(_searches(spark, folder), {"boosted": SETTINGS["boosted"]})
    return _rounded(fused).select(*_CANDIDATE)


def _searches(spark, folder) -> DataFrame:
    return prepared(spark, folder).candidates.merged


def q_rerank_pairs(spark, folder):
    run = found(spark, folder)
    rows = rerank(run.merged, 25, pair_scores(prepared(spark, folder)))
    return rows.select("query_id", "passage_id", "hybrid_score", "rerank_score", "rank_rerank")


def q_broken_pair_scores(spark, folder):
    return count_broken_scores(pair_scores(prepared(spark, folder)))


def q_rerank_scorer(spark, folder):
    """Reranked by a scorer that fails for some questions, which keep their hybrid order as a whole."""
    def term_share():
        import re

        def score(asked: list, texts: list) -> list:
            if any(q[:1].lower() in "aeiou" for q in asked):
                raise ValueError("a vowel")
            words = [[set(re.findall("[a-z]+", x.lower())) for x in pair] for pair in zip(asked, texts)]
            return [len(q & t) / max(len(q), 1) for q, t in words]

        return score

    base, run = prepared(spark, folder), found(spark, folder)
    top = run.merged.where("rank_hybrid < 25")
    scores = score_pairs_in_batches(top, base.candidates.questions, base.index.passages, term_share, 16)
    rows = rerank(run.merged, 25, scores, whole_queries=True)
    return rows.select("query_id", "passage_id", F.round("rerank_score", 6).alias("rerank_score"), "rank_rerank")


def q_context_expand(spark, folder):
    rows = found(spark, folder, with_pairs=True).contexts
    return rows.select("query_id", "passage_id", "anchor_text", "section_title",
                       "section_order_index",
                       F.array_join("window_passage_ids", " ").alias("window_passage_ids"),
                       "window_text")


def q_context_places(spark, folder):
    """The same contexts from passages that are stored by neighbourhood."""
    run = found(spark, folder, with_pairs=True)
    store = store_places(prepared(spark, folder).index.passages)
    rows = context_from_places(run.anchors, store, RetrievalConfig().context_window_radius)
    return rows.select("query_id", "passage_id", "anchor_text", "section_title", "section_order_index",
                       F.array_join("window_passage_ids", " ").alias("window_passage_ids"), "window_text")


def q_evidence_bundle(spark, folder):
    rows = bundle_anchors(found(spark, folder, with_pairs=True).bundles)
    score = F.col("scores")
    return rows.select(
        "query_id", "rank", "passage_id", "text",
        F.array_join("window_passage_ids", " ").alias("window_passage_ids"), "kept_text",
        *[score[name].alias(f"{name}_score") for name in ("lexical", "dense", "hybrid", "rerank")])


def q_retrieval_debug(spark, folder):
    """Heads of the four candidate lists of every question."""
    run = found(spark, folder)
    rows = debug_record(run, RetrievalConfig(), top_k=10)

    def ids(c):
        return F.array_join(F.col(f"{c}.passage_id"), " ").alias(c)

    return rows.select("query_id", "normalized_query", "lexical_query", ids("lexical_hits"),
                       ids("dense_hits"), ids("merged_candidates"), ids("reranked_candidates"))


def q_gold_quotes(spark, folder):
    base = prepared(spark, folder)
    return base.gold.select("query_id", F.explode("expected_ids").alias("passage_id"))


def q_gold_many_quotes(spark, folder):
    """Where the lines of all questions stand, those of one or two words too."""
    base = prepared(spark, folder)
    lines = F.array_distinct(F.split(normalize_text(F.col("question")), "\n"))
    asked = base.questions.select("query_id", F.explode(lines).alias("quote"))
    return ev.locate_many_quotes(base.index.passages, asked)


def q_gold_references(spark, folder):
    """Two unit references per question, looked up in the numbered corpus."""
    passages = ingest(documents(spark, folder, _unit_text(F.col("text")))).passages
    n = F.col("query_id").cast("int")
    wanted = questions(spark, folder).select("query_id", F.array(
        F.concat(F.lit("1|"), (n % 3 + 1).cast("string")),
        F.concat((n + 1).cast("string"), F.lit("|"), (n * 3 + 1).cast("string"))).alias("refs"))
    rows = ev.resolve_references(passages, wanted)
    return rows.select("query_id", F.array_join("expected_ids", " ").alias("expected_ids"))


_METRICS = [f"{m}_at_{k}" for k in (5, 10, 20) for m in ("hit", "recall", "precision")] + ["mrr"]


def _evaluated(spark, folder, compat: bool = False) -> DataFrame:
    run = found(spark, folder, with_pairs=True)
    return ev.evaluate_bundles(eval_items(prepared(spark, folder)), run.bundles, compat)


def q_retrieval_metrics(spark, folder):
    rows = _evaluated(spark, folder)
    return rows.select(
        "query_id", F.array_join("retrieved_ids", " ").alias("retrieved_ids"),
        *[F.round(m, 6).alias(m) for m in [*_METRICS, "anchor_hit_at_5", "anchor_mrr"]])


def q_retrieval_metrics_compat(spark, folder):
    rows = _evaluated(spark, folder, compat=True)
    return rows.select("query_id", *[F.round(m, 6).alias(m) for m in _METRICS])


_answered: dict[tuple, Answers] = {}


def _drafts(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundles with drafts from synthesised model answers, and their reports; written once."""
    bundles = found(spark, folder, with_pairs=True).bundles
    key = (spark.sparkContext.applicationId, folder)
    if key not in _answered:
        results = resolve_attempts(check_outputs(_model_answers(bundles), ANSWER))
        _answered[key] = answer(bundles, results)
    return bundles, _answered[key].drafts, _answered[key].reports


def _model_answers(bundles: DataFrame, sound: bool = False) -> DataFrame:
    """What a model might have answered, by question number modulo five: a sound
    answer, one in a code fence with an altered quote, one that cites an
    unknown passage, one without claims support, and broken JSON."""
    kind = F.lit(0) if sound else F.col("query_id").cast("int") % 5
    top = F.get("anchors", 0)
    claim = F.struct(
        F.lit("c1").alias("claim_id"), top["text"].alias("statement"),
        F.when(kind == 2, F.array(F.lit("ghost"))).when(
            kind == 3, F.array().cast("array<string>")).otherwise(F.array(top["passage_id"]))
        .alias("supporting_passage_ids"), F.lit("direct").alias("support_type"))
    second = F.struct(
        F.lit("c2").alias("claim_id"), F.get("anchors", 1)["text"].alias("statement"),
        F.array(F.get("anchors", 1)["passage_id"]).alias("supporting_passage_ids"),
        F.lit("interpretive").alias("support_type"))
    quote = F.when(kind == 1, F.concat(F.substring(top["text"], 1, 20), F.lit(" ..."))).otherwise(
        F.substring(top["text"], 1, 40))
    citations = F.array(
        F.struct(top["passage_id"].alias("passage_id"), quote.alias("quote")),
        F.struct(F.when(kind == 2, "ghost").otherwise(F.get("anchors", 1)["passage_id"])
                 .alias("passage_id"), F.lit("").alias("quote")))
    output = F.to_json(F.struct(
        top["text"].alias("final_answer"), F.array(claim, second).alias("claims"),
        citations.alias("supporting_citations"),
        F.array(F.struct(F.lit("open").alias("issue"), F.array(top["passage_id"])
                         .alias("related_passage_ids"))).alias("objections_raised"),
        F.lit("noted").alias("confidence_notes")))
    raw = F.when(kind == 1, F.concat(F.lit("```json\n"), output, F.lit("\n```"))).when(
        kind == 4, F.lit('{"final_answer": ')).otherwise(output)
    return bundles.where(F.size("anchors") > 1).select(
        "query_id", F.lit(1).alias("attempt"), raw.alias("raw_output"))


def q_answer_drafts(spark, folder):
    _, drafts, _ = _drafts(spark, folder)
    return drafts.select(
        "query_id", "mode", "final_answer", F.size("claims").cast("int").alias("n_claims"),
        F.array_join(F.col("supporting_citations.passage_id"), " ").alias("cited"),
        F.array_join("raw_unknown_ids", " ").alias("unknown_ids"), "repair_succeeded")


def q_answer_rounds(spark, folder):
    """Failed answers are given again, soundly this time."""
    bundles = found(spark, folder, with_pairs=True).bundles
    first = resolve_attempts(check_outputs(_model_answers(bundles), ANSWER))
    second = resolve_attempts(check_outputs(_model_answers(bundles, sound=True), ANSWER))
    out = answer(bundles, first, second_answers=second)
    return out.responses.join(out.reports.select("query_id", "round"), "query_id").select(
        "query_id", "round", "verification_status", "final_answer")


def q_citation_check(spark, folder):
    bundles, drafts, reports = _drafts(spark, folder)
    rows = ans.citation_rows(drafts, bundles).select(
        "query_id", "place", "passage_id", "quote", "passage_text")
    issues = reports.select("query_id", F.explode_outer("citation_issues").alias("i")).select(
        "query_id", F.col("i.passage_id").alias("passage_id"), F.col("i.issue").alias("issue"))
    return rows.join(issues, ["query_id", "passage_id"], "left")


def q_claim_support(spark, folder):
    _, _, reports = _drafts(spark, folder)
    return reports.select(
        "query_id", "status", "mode", F.array_join("supported_claims", " ").alias("supported"),
        F.array_join(F.col("unsupported_claims.claim_id"), " ").alias("unsupported"))


def q_final_response(spark, folder):
    bundles, drafts, reports = _drafts(spark, folder)
    return ans.final_responses(drafts, reports, bundles).select(
        "query_id", "final_answer", F.size("citations").cast("int").alias("n_citations"),
        F.array_join("objections", "|").alias("objections"), "verification_status",
        F.array_join("verification_warnings", "|").alias("warnings"), "error")


def _without_evidence(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bundles with the anchors of every fourth question taken away, no model
    answers, and what the answering plan makes of them."""
    bundles = found(spark, folder, with_pairs=True).bundles
    bundles = bundles.withColumn("anchors", F.when(
        F.col("query_id").cast("int") % 4 == 1, F.slice("anchors", 1, 0)).otherwise(F.col("anchors")))
    drafts = ans.answer_drafts(bundles)
    return bundles, drafts, ans.verification_reports(drafts, bundles)


def q_final_response_errors(spark, folder):
    """Questions without evidence get their error instead of vanishing."""
    bundles, drafts, reports = _without_evidence(spark, folder)
    return ans.final_responses(drafts, reports, bundles).select(
        "query_id", "verification_status", F.size("citations").cast("int").alias("n_citations"),
        F.size("verification_warnings").cast("int").alias("n_warnings"), "error")


def q_grounding_metrics(spark, folder):
    bundles, drafts, reports = _drafts(spark, folder)
    rows = ev.grounding_metrics(drafts, reports, bundles)
    return rows.withColumns({c: F.round(c, 6) for c in
                             ("citation_validity_rate", "claim_support_rate")})


def q_run_summary(spark, folder):
    bundles, drafts, reports = _drafts(spark, folder)
    grounded = ev.grounding_metrics(drafts, reports, bundles)
    return ev.summarize_run(_evaluated(spark, folder).join(grounded, "query_id", "left"))


def q_failure_types(spark, folder):
    base, run = prepared(spark, folder), found(spark, folder, with_pairs=True)
    rows = ev.classify_failures(eval_items(base), ev.stage_ids(run.merged, run.reranked))
    return rows.select("query_id", "hit_at_5", "hit_at_10", "failure", "failure_type", "miss_both",
                       "fusion_miss", F.array_join("retrieved_ids", " ").alias("retrieved_ids"))


def q_model_run_summary(spark, folder):
    base, run = prepared(spark, folder), found(spark, folder, with_pairs=True)
    results = resolve_attempts(check_outputs(_model_answers(run.bundles), ANSWER))
    return model_run(eval_items(base), run, "synthetic", answers=results)[1]


def q_sweep_summary(spark, folder):
    base, run = prepared(spark, folder), found(spark, folder)
    fused, reranked = sweep(_searches(spark, folder), SETTINGS, pair_scores(base))
    rows = sweep_results(eval_items(base), fused, reranked, tuple(SETTINGS))
    kinds = F.col("failure_type")
    return rows.groupBy("label").agg(
        F.count("*").alias("n_questions"), F.count_if("hit_at_5").alias("n_hit_5"),
        F.count_if("hit_at_10").alias("n_hit_10"), F.count_if("failure").alias("n_failures"),
        *[F.count_if(kinds == k).alias(f"n_{k}") for k in
          ("lexical_miss", "dense_miss", "rerank_miss", "unknown")],
        F.count_if("fusion_miss").alias("n_fusion_miss"))


def q_sweep_mixed_compat(spark, folder):
    """A setting that reproduces the rerank quirk beside one that does not: the
    order of the other setting is what it is alone."""
    base = prepared(spark, folder)
    settings = {"fixed": RetrievalConfig(), "quirk": RetrievalConfig(compat=True)}
    _, reranked = sweep(_searches(spark, folder), settings, pair_scores(base))
    _, alone = sweep(_searches(spark, folder), {"fixed": settings["fixed"]}, pair_scores(base))
    same = reranked.where("label = 'fixed'").join(
        alone.select("query_id", "passage_id", F.col("rank_rerank").alias("rank_alone")), ["query_id", "passage_id"])
    return same.select("query_id", "passage_id", (F.col("rank_rerank") == F.col("rank_alone")).alias("same_rank"))


def _turn_outputs(spark, folder) -> DataFrame:
    """Every conversation turn as three model attempts, sound or broken by its number."""
    rows = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    item = F.struct("passage_id", "quote")
    tries = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"), "conv_id",
        "turn", "text", F.col("role").alias("passage_id"), F.substring("text", 1, 30).alias("quote"))
    kind = (F.col("conv_id") + F.col("turn") * 2 + F.col("attempt") * 3) % 10
    answer = F.to_json(F.struct(
        F.col("text").alias("final_answer"),
        F.array().cast("array<struct<claim_id:string,statement:string,"
                       "supporting_passage_ids:array<string>,support_type:string>>").alias("claims"),
        F.array(item).alias("supporting_citations"),
        F.array().cast("array<struct<issue:string,related_passage_ids:array<string>>>")
        .alias("objections_raised"),
        F.lit("noted").alias("confidence_notes")))
    raw = (
        F.when(kind == 0, answer)
        .when(kind == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is:\n"), answer, F.lit("\nDone.")))
        .when(kind == 3, F.substring(answer, 1, 40))
        .when(kind == 4, F.replace(answer, F.lit('"noted"'), F.lit("7")))
        .when(kind == 5, F.replace(answer, F.lit('"claims":[]'), F.lit('"claims":{}')))
        .when(kind == 6, F.replace(answer, F.lit('"confidence_notes"'), F.lit('"notes"')))
        .when(kind == 7, F.lit(None).cast("string"))
        .when(kind == 9, F.concat(answer, F.lit(" Done.")))
        .otherwise(F.replace(answer, F.lit('"quote":"'), F.lit('"note":"')))
    )
    return tries.select("query_id", "attempt", raw.alias("raw_output"),
                        F.when(kind == 7, "timed out").alias("transport_error"))


def q_json_validate(spark, folder):
    rows = check_outputs(_turn_outputs(spark, folder), ANSWER)
    return rows.select("query_id", "attempt", "failure_stage", "repair_attempted",
                       "repair_succeeded", F.col("parsed.final_answer").alias("final_answer"))


def q_json_resolve(spark, folder):
    rows = resolve_attempts(check_outputs(_turn_outputs(spark, folder), ANSWER))
    return rows.select("query_id", "success", "attempts", "repair_attempted", "repair_succeeded",
                       F.size("raw_outputs").cast("int").alias("n_outputs"))


def q_latest_artifact(spark, folder):
    """The last turn of every conversation, as the newest artifact of a query."""
    rows = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    return latest(rows.select(F.col("conv_id").cast("string").alias("query_id"), "turn", "role",
                              "text"), "turn")


def q_answer_prompts(spark, folder):
    run = found(spark, folder, with_pairs=True)
    return prompts.answer_prompts(run.questions, run.bundles)


def q_verifier_prompts(spark, folder):
    bundles, drafts, _ = _drafts(spark, folder)
    return prompts.verifier_prompts(found(spark, folder, with_pairs=True).questions, bundles, drafts)


def q_query_overview(spark, folder):
    bundles, drafts, reports = _drafts(spark, folder)
    rows = ans.query_overview(questions(spark, folder), bundles, drafts, reports)
    return rows.select("query_id", "question", "final_answer", F.size("citations").cast("int")
                       .alias("n_citations"), "verification_status")


def q_unit_rejects(spark, folder):
    """Per document its numbered lines, those that are units and those that are not, by reason."""
    docs = documents(spark, folder, _unit_text(F.col("text")), sectioning="explicit")
    rows = check_units(docs).groupBy("document_id")
    return rows.agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("reason").isNull()).alias("n_units"),
        *[F.count_if(F.col("reason") == reason).alias(name) for name, reason in (
            ("n_blank", "blank"), ("n_short", "fewer than three fields"), ("n_chapter", "chapter is no number"))])


def q_question_rejects(spark, folder):
    """The benchmark as question files of ten items, some broken; items that pass and rejects with
    their reasons. Every fourth file is cut off."""
    n = F.col("item_id")
    item = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("text").alias("question"),
        F.array(F.lit("p1")).alias("expected_relevant_passage_ids")))
    item = F.when(n % 7 == 1, F.replace(item, F.lit('"question"'), F.lit('"asked"'))).when(
        n % 7 == 2, F.replace(item, F.lit('["p1"]'), F.lit('"p1"'))).when(
        n % 7 == 3, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(item)
    group = F.floor(n / 10).alias("g")
    rows = table(spark, folder, "benchmark").select(group, F.struct(n.alias("n"), item.alias("item")).alias("i"))
    text = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("i"))["item"], ","), F.lit("]"))
    files = rows.groupBy("g").agg(text.alias("value")).select(
        "g", F.when(F.col("g") % 4 == 3, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))
    path = new_folder(spark, "questions")
    files.write.partitionBy("g").text(path)
    checked = check_eval_items(spark, path)
    return checked.select(
        F.regexp_extract("source", r"g=(\d+)", 1).alias("file"), "place",
        F.when(F.col("reason").isNull(), F.col("query_id")).alias("query_id"),
        F.when(F.col("reason").isNull(), F.col("question")).alias("question"),
        F.when(F.col("reason").isNull(), F.array_join("expected_ids", " ")).alias("expected_ids"), "reason")


def q_bm25_topk_saved(spark, folder):
    """The same search over an index that was saved, beside one of a project with a like name."""
    base, path = prepared(spark, folder), new_folder(spark, "projects")
    save_index(base.index, path, "1")
    save_index(base.index, path, "01")
    index = load_index(spark, path, "01")
    return bm25_search(index.lexical, prepare_questions(base.questions), 10).select(
        "query_id", "passage_id", "lexical_score", "rank_lexical")


def q_project_documents(spark, folder):
    """Documents stored by source as projects, three of which are read."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("project_id"))
    path = new_folder(spark, "projects")
    save_projects(docs, path)
    wanted = docs.select("project_id").distinct().orderBy("project_id").limit(3)
    return load_documents(spark, path, wanted).groupBy("project_id").agg(
        F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


def q_stored_candidates(spark, folder):
    """Candidates saved twice under the name of their run, and read back in rank order."""
    path = new_folder(spark, "candidates")
    for _ in range(2):
        save_candidates(found(spark, folder, with_pairs=True).reranked, path, "run 1")
    return read_candidates(spark, path).select("query_id", "passage_id", "raw_score", "rank")


def q_stored_results(spark, folder):
    """Metrics saved under two labels that are one number, the first of them twice."""
    path, rows = new_folder(spark, "results"), _evaluated(spark, folder).select("query_id", *_METRICS)
    for label in ("1", "1.0", "1"):
        save_results(rows, path, label)
    return read_results(spark, path, "1").select("query_id", *[F.round(m, 6).alias(m) for m in _METRICS], "label")


def q_eval_run(spark, folder):
    """A whole evaluation in one call, from questions to the summary."""
    base, bundles = prepared(spark, folder), found(spark, folder, with_pairs=True).bundles
    answers = resolve_attempts(check_outputs(_model_answers(bundles), ANSWER))
    return run_eval(eval_items(base), base.index, answers=answers, pair_scores=pair_scores(base)).summary


def q_eval_run_retrieval(spark, folder):
    """The same without answers."""
    base = prepared(spark, folder)
    return run_eval(eval_items(base), base.index, pair_scores=pair_scores(base), generation=False).summary


def _before(base) -> DataFrame:
    """query_id and the gold of the question before."""
    return eval_items(base).select((F.col("query_id").cast("int") + 1).cast("string").alias("query_id"),
                                   F.col("expected_ids").alias("gold_before"))


def q_failure_histogram(spark, folder):
    """Failures by type where the gold of every question is that of the one before."""
    base, run = prepared(spark, folder), found(spark, folder, with_pairs=True)
    items = base.questions.join(_before(base), "query_id").withColumnRenamed("gold_before", "expected_ids")
    return model_run(items, run, "shifted", generation=False)[2]


def _model_reports(drafts: DataFrame, bundles: DataFrame) -> DataFrame:
    """What a verifier might have said, by question number modulo four: all is well, with claims
    and passages that are not there; an open claim; two broken outputs and then a pass; no JSON."""
    kind = F.col("query_id").cast("int") % 4
    claims = F.transform("claims", lambda c: c["claim_id"])
    top = F.get("anchors", 0)["passage_id"]
    report = F.to_json(F.struct(
        F.when(kind == 1, "fail").otherwise("pass").alias("status"), claims.alias("supported_claims"),
        F.array(*[F.struct(c.alias("claim_id"), F.lit("why").alias("reason")) for c in (
            F.lit("ghost"), F.when(kind == 1, F.get(claims, F.lit(0))).otherwise(F.lit("none")))]).alias("unsupported_claims"),
        F.array(*[F.struct(p.alias("passage_id"), F.lit("odd").alias("issue")) for p in (
            F.lit("ghost"), top)]).alias("citation_issues"), F.lit("checked").alias("notes")))
    rows = drafts.where("error IS NULL").join(bundles.select("query_id", "anchors"), "query_id").select(
        "query_id", report.alias("report"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"))
    return rows.select("query_id", "attempt", F.when((F.col("kind") == 3) | ((F.col("kind") == 2) & (F.col("attempt") < 3)),
                                                     F.lit('{"status":')).otherwise(F.col("report")).alias("raw_output"))


def _judged_drafts(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    bundles, drafts, _ = _drafts(spark, folder)
    results = resolve_attempts(check_outputs(_model_reports(drafts, bundles), REPORT))
    return bundles, drafts, ans.verification_reports(drafts, bundles, results)


def q_model_reports(spark, folder):
    """Drafts checked by a model: its claims and passages that are not there are left out."""
    _, _, reports = _judged_drafts(spark, folder)
    return reports.select(
        "query_id", "status", "mode", "attempts", F.array_join("supported_claims", " ").alias("supported"),
        F.array_join(F.col("unsupported_claims.claim_id"), " ").alias("unsupported"),
        F.size("citation_issues").alias("n_issues"))


def q_model_responses(spark, folder):
    """The responses of these drafts, some of them with the status pass."""
    bundles, drafts, reports = _judged_drafts(spark, folder)
    return ans.final_responses(drafts, reports, bundles).select(
        "query_id", "verification_status", F.col("error").isNull().alias("answered"))


def q_correction_prompts(spark, folder):
    """The prompts that ask again where an output did not parse or fit: what they begin and end with."""
    checked = check_outputs(_turn_outputs(spark, folder), ANSWER)
    asked = checked.select("query_id", F.concat(F.lit("Prompt of "), "query_id").alias("prompt")).distinct()
    rows = prompts.correction_prompts(checked, asked, ANSWER)
    raw = checked.select("query_id", "attempt", "raw_output", "failure_stage")
    return rows.join(raw, ["query_id", "attempt"]).select(
        "query_id", "attempt", "failure_stage", F.startswith("prompt", F.concat(F.lit("Prompt of "), "query_id", F.lit("\n\n")))
        .alias("begins"), F.endswith("prompt", F.col("raw_output")).alias("ends"))


def q_retrieval_metrics_alternatives(spark, folder):
    """Items that also accept the gold of the question before."""
    base = prepared(spark, folder)
    items = eval_items(base).join(_before(base), "query_id", "left").withColumnRenamed("gold_before", "alternative_ids")
    rows = ev.evaluate_bundles(items, found(spark, folder, with_pairs=True).bundles)
    return rows.select("query_id", *[F.round(m, 6).alias(m) for m in [*_METRICS, "anchor_hit_at_5", "anchor_mrr"]])


def q_query_overview_rounds(spark, folder):
    """Two rounds of artifacts that came in mixed: drafts of the first round without evidence, those of
    the second as they are, and a bundle after them that no draft has seen."""
    bundles, drafts, reports = _drafts(spark, folder)

    def made(rows: DataFrame, minute: int, name: str) -> DataFrame:
        return rows.withColumns({"created_at": F.to_timestamp(F.lit(f"2024-05-01 10:{minute:02d}:00")),
                                 "artifact_id": F.lit(name)})

    bare = bundles.withColumn("anchors", F.slice("anchors", 1, 0))
    poor, wrong = drafts.withColumn("final_answer", F.lit("first")), reports.withColumn("status", F.lit("fail"))
    rows = ans.query_overview_as_of(
        questions(spark, folder),
        made(bare, 1, "a").unionByName(made(bundles, 4, "b")).unionByName(made(bare, 9, "c")),
        made(poor, 2, "a").unionByName(made(drafts, 5, "b")),
        made(wrong, 3, "a").unionByName(made(wrong, 6, "b")).unionByName(made(reports, 6, "c")))
    return rows.select("query_id", "question", "final_answer", F.size("citations").cast("int").alias("n_citations"),
                       F.array_join(F.transform("citations", lambda c: (F.length(c["passage_text"]) > 0).cast("string")), " ")
                       .alias("with_text"), "verification_status")


def q_context_lost(spark, folder):
    """Contexts of anchors that are in no passage table, every second with a text of its own."""
    base = prepared(spark, folder)
    own = F.when(F.col("query_id").cast("int") % 2 == 0, F.col("question"))
    anchors = base.questions.select("query_id", F.concat(F.lit("lost-"), "query_id").alias("passage_id"),
                                    own.alias("passage_text"), F.lit("Lost").alias("section_title"))
    rows = expand_context(anchors, base.index.passages)
    return rows.select("query_id", "passage_id", "anchor_text", "section_title", "section_order_index",
                       F.array_join("window_passage_ids", " ").alias("window_passage_ids"), "window_text")


def q_context_from_windows(spark, folder):
    """The windows of the anchors, read from a window table."""
    run, docs = found(spark, folder, with_pairs=True), documents(spark, folder)
    rows = context_from_windows(run.anchors, windows_table(split_documents(docs), radius=1))
    return rows.select("query_id", "passage_id", F.array_join("window_passage_ids", " ").alias("window_passage_ids"),
                       "window_text")


def q_stored_artifacts(spark, folder):
    """Bundles stored twice under the name of their run, and read back with the time they were made."""
    path, bundles = new_folder(spark, "artifacts"), found(spark, folder, with_pairs=True).bundles
    for _ in range(2):
        save_artifact(bundles, path, "bundles", "run 1")
    rows = read_artifact(spark, path, "bundles")
    age = F.timestamp_diff("MINUTE", F.col("created_at"), F.current_timestamp())
    return rows.select("query_id", F.size("anchors").alias("n_anchors"), age.between(0, 600).alias("recent"))


def q_objection_issues(spark, folder):
    """Objections stored as texts, as objects, or as both, made of conversation turns."""
    rows = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    plain, item = F.col("text"), F.struct(F.col("text").alias("issue"), F.array("role").alias("related_passage_ids"))
    kind = F.col("turn") % 3
    raw = F.when(kind == 0, F.to_json(F.array(plain))).when(kind == 1, F.to_json(F.array(item, item))).otherwise(
        F.concat(F.lit("["), F.to_json(item), F.lit(', "open"]')))
    return rows.select("conv_id", "turn", F.array_join(ans.objection_issues(raw), " | ").alias("issues"))


def registered() -> dict:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
