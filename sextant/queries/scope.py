"""Rows of the survey without a query of their own name: those that another query covers, and those that have none, and why."""

NOT_APPLICABLE = {
    "S8": "reads of an embedded database: Spark tables take its place",
    "S9": "plans.index.opened (version, chunking) over streaming.sync.read_table (backup), tested without SQL",
    "S11": "model files: operators.vector.embedder takes vocabulary and matrix as parameters",
    "K1": "plans.index.build: chunks, postings, lengths, each swapped in", "K2": "plans.index.build: files, symbols, imports, calls, edges, meta", "K4": "plans.index.build: vectors",
    "K5": "texts for terminals: output.hint_lines formats rows, the DataFrame is the interface",
    "R3": "streaming.sync.spaced, tested as a stream", "R8": "Spark's cache policy; streaming.sync.Watchers bounds resident streams",
    "X52": "transport", "Z8": "the meta table of plans.index, written last", "Z9": "wrappers of rankers: exceptions are Spark's",
    "Z15": "StreamingQuery.status through Watchers.status", "Z16": "streaming.sync.Watchers", "Z17": "no embedded database",
    "Z18": "texts for terminals", "Z21": "remote loop", "Z22": "plans.search.Options", "Q6": "plans.index.build with an embedder; operators.vector: split_units, embedder, search, collapse",
    "Q9": "plans.index: stored postings, lengths, vocabulary; searches take them", "Q12": "transport",
}

#: Row -> the query that computes it.
COVERED_BY = {
    "A15": "m4_merge_candidates", "A21": "t_exec", "F4": "l2_vector_topk_batch", "J2": "a4_bm25", "J3": "a6_subword_scores", "J4": "a7_path_scores", "J15": "m4_merge_candidates", "K6": "z11_hint_lines",
    "L1": "x18_rerank", "Q1": "hybrid_search", "Q10": "a18_quality", "R4": "r1_event_stream", "S10": "l2_vector_topk_batch", "T-readfile": "l10_line_page", "T-rg": "t_rg", "T-ls": "t_ls", "T-tree": "t_tree",
    "T-glob": "t_glob", "T-exec": "t_exec", "U5": "m6_remote_union", "W2": "m1_chunk_rrf", "W3": "m1_chunk_rrf", "W5": "l3_dynamic_top_k", "W8": "m2_clause_rrf", "X32": "x1_identifier_parts", "X38": "x39_embed",
    "Z2": "a9_graph_scores", "Z3": "a10_query_coverage", "Z5": "z20_sync_report", "Z7": "j12_changed_and_deleted", "Z12": "f8_result_normaliser", "Z19": "f8_result_normaliser",
}
