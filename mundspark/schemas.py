"""Canonical tables and how a frame is brought into one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



#: Columns and types of the canonical tables, as DDL.
TABLES = {
    "utterance": "path string, sentence string, sentence_source string, client_id string, canton string, dialect_region string, zipcode string, age string, gender string, dataset string, audio_path string, label_id int",
    "phoneme_utt": "audio_path string, label_id int, phoneme string",
    "clip_master": "clip_path string, podcast string, episode string, speaker string, start double, end double, duration_sec double, phoneme string",
    "speaker_assignment": "podcast string, episode string, speaker string, is_german int, prob_non_german double, prob_german double, dialect_pred int, dialect_probs array<double>, final_label_id int, final_label_name string, num_docs long, num_clips long",
    "clip_label": "audio_path string, final_label_id int, podcast string, episode string, speaker string",
    "segment": "start double, end double, speaker string, text string, overlap_coverage double",
    "asr_pred": "audio_path string, label_id int, reference string, prediction string",
    "synth_eval": "model string, sentence_id string, text string, wav_path string, wer double, cer double, rtf double, speaker_cosine double, dialect_pred string, dialect_prob double, asr_hypothesis string",
    "train_scalar": "step long, epoch double, loss double, learning_rate double, grad_norm double, run string",
}

#: Other names under which columns come (fixed values).
ALIASES = {"audio_path": ("clip_path", "path"), "duration_sec": ("duration",), "speaker": ("speaker_id", "client_id"), "sentence": ("text",)}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def resolve(df: DataFrame, column: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> str | None:
    """The name under which df has a column: its own, or the first of its aliases; None without."""
    return next((c for c in (column, *aliases.get(column, ())) if c in df.columns), None)


def conform(df: DataFrame, table: str, aliases: dict[str, tuple[str, ...]] = ALIASES, defaults: dict | None = None) -> DataFrame:
    """df with exactly the columns of a canonical table, cast; those it lacks are NULL or the default."""
    cols = []
    for part in TABLES[table].split(", "):
        name, kind = part.split(" ", 1)
        at = resolve(df, name, aliases)
        c = df[f"`{at}`"].try_cast(kind) if at else F.lit((defaults or {}).get(name)).cast(kind)
        cols.append(c.alias(name))
    return df.select(*cols)
