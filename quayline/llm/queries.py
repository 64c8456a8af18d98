"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quayline.llm import ann, decontam, html_text, importance, licenses, line_dedup, lm, mixing, near_dup, prefix_trie, secrets, token_counts, toxicity
from quayline.storage import table


def op1_secret_scan(spark, sf_dir):
    """Secrets in every whole text of documents."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    """Passages to remove from documents because they stand earlier in the corpus."""
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    """Toxicity of every whole text, learned from the rows that may be learned from."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    """Tokens of every whole text, by the separator scan of flat token streams."""
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    """Licence families of all paragraphs of documents."""
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark, sf_dir):
    """All documents mixed to the sources' target weights."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one."""
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_lm_score(spark, sf_dir):
    """Log probabilities of every whole text, learned from four folds of five."""
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    """Documents that hold benchmark items, verbatim or re-parameterised."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resample(spark, sf_dir):
    """Importance of every document for the benchmark's texts, and the tenth that is drawn."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark, sf_dir):
    """The trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_html_text(spark, sf_dir):
    """The main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_near_dup": op4_near_dup,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
    "op11_importance_resample": op11_importance_resample,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_html_text": op13_html_text,
}

ORACLES = {
    "op1_secret_scan": secrets.ORACLE_SQL,
    "op7_mix_sources": mixing.ORACLE_SQL,
    "op11_importance_resample": importance.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
}
