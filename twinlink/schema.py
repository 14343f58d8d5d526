"""Table schemas, enumerations and the model registry."""

from __future__ import annotations

from pyspark.sql import types as T


def _required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=False)


PAIRS = T.StructType(
    [_required("d1_id", T.StringType()), _required("pos", T.LongType()), _required("d2_id", T.StringType())]
)

RECORDS = T.StructType([_required("record_id", T.StringType()), _required("text", T.StringType())])

EMBEDDINGS = T.StructType(
    [
        _required("record_id", T.StringType()),
        _required("dataset", T.StringType()),
        _required("embeddings", T.ArrayType(T.FloatType(), containsNull=False)),
        _required("created_at", T.TimestampType()),
        _required("model", T.StringType()),
    ]
)

TASK_EMBEDDINGS = T.StructType(
    [
        _required("d1_reference_id", T.StringType()),
        _required("record_id", T.StringType()),
        _required("is_d2", T.BooleanType()),
        _required("embeddings", T.ArrayType(T.FloatType(), containsNull=False)),
        _required("created_at", T.TimestampType()),
        _required("model", T.StringType()),
    ]
)

# prompt_group is the family a prompt belongs to, kept next to the exact variant that was asked.
RESULTS = T.StructType(
    [
        _required("d1_id", T.StringType()),
        _required("d2_candidates_id", T.ArrayType(T.StringType())),
        T.StructField("result", T.StringType()),
        _required("request_status", T.StringType()),
        _required("inserted_at", T.TimestampType()),
        _required("prompt_type", T.StringType()),
        _required("prompt_group", T.StringType()),
        _required("model", T.StringType()),
        _required("run_id", T.StringType()),
    ]
)

# Metric names, answer states, modes and prompt types.
COSINE, EUCLIDEAN = "cosine", "euclidian"
NO_RESPONSE, INVALID, VALID = "NO_RESPONSE", "INVALID", "VALID"
# A request that never came through: no answer state, so it is never logged and asked again.
FAILED = "FAILED"
MATCHING, COMPARING, SELECTING = "MATCHING", "COMPARING", "SELECTING"
PROMPTS_BY_MODE = {
    MATCHING: ("MATCHING_PROMPT", "MATCHING_PROMPT_ONLY"),
    COMPARING: ("COMPARING_PROMPT", "COMPARING_PROMPT_ONLY"),
    SELECTING: ("SELECTING_PROMPT", "SELECTING_PROMPT_ONLY"),
}

# Embedding models as (key, published name, loader family).
EMBEDDING_MODELS = [
    ("ROBERTA_LARGE", "xlm-roberta-large", "token"),
    ("QWEN_2_5_7B", "Qwen/Qwen2.5-7B-Instruct", "token"),
    ("STELLA_EN", "dunzhang/stella_en_1.5B_v5", "sentence"),
    ("EMBER_V1", "llmrails/ember-v1", "sentence"),
    ("MINI_LM_V6", "sentence-transformers/all-MiniLM-L6-v2", "sentence"),
    ("MINI_LM_L12_V2", "sentence-transformers/all-MiniLM-L12-v2", "sentence"),
    ("BGE_M3", "BAAI/bge-m3", "baai"),
    ("BGE_EN_ICL", "BAAI/bge-en-icl", "baai_icl"),
    ("E5_MISTRAL_7B", "intfloat/e5-mistral-7b-instruct", "token"),
    ("SFR_EMBEDDING_MISTRAL", "Salesforce/SFR-Embedding-Mistral", "sentence"),
    ("GEMMA_EMBEDDINGS", "google/Gemma-Embeddings-v1.0", None),
    ("PHI_3", "microsoft/Phi-3.5-mini-instruct", "token"),
    ("GTE_QWEN2", "Alibaba-NLP/gte-Qwen2-7B-instruct", "sentence"),
    ("JASPER_TOKEN_COMPRESSION", "infgrad/Jasper-Token-Compression-600M", "jasper"),
    ("OCTEN_EMBEDDING_4B", "Octen/Octen-Embedding-4B", "sentence"),
    ("NEMOTRON_3_EMBED_8B", "nvidia/Nemotron-3-Embed-8B-BF16", "nemotron"),
    ("NEMOTRON_3_EMBED_1B", "nvidia/Nemotron-3-Embed-1B-BF16", "nemotron"),
    ("JINA_EMBEDDINGS_V5_OMNI_SMALL", "jinaai/jina-embeddings-v5-omni-small", "jina"),
    ("KITEFISH_NANO_EM1_06B", "KiteFishAI/Nano-Em1-0.6B-v2.1", "sentence"),
    ("QWEN_3_5_EMBEDDING_4B", "Qwen/Qwen3-Embedding-4B", "sentence"),
    ("F2LLM_4B", "codefuse-ai/F2LLM-4B", "f2"),
    ("GIGA_CHAT_3B", "ai-sage/Giga-Embeddings-instruct-3B-0826", "sentence"),
    ("EMBEDDING_GEMMA", "google/embeddinggemma-300m", "sentence"),
]

# Chat models as (key, served name).
CHAT_MODELS = [
    ("LLAMA3_1_INSTRUCT", "llama3.1:8b-instruct-q5_K_M"),
    ("PHI_3_INSTRUCT", "phi3.5:3.8b-mini-instruct-q8_0"),
    ("MISTRAL_NEMO_INSTRUCT", "mistral-nemo:12b-instruct-2407-q5_K_M"),
    ("QWEN_2_5", "qwen2.5:14b"),
    ("GEMMA_2", "gemma2:9b-instruct-q5_K_M"),
    ("SOLAR", "solar-pro:22b"),
    ("GRANITE_CODE", "granite-code:20b-instruct-8k-q5_K_M"),
    ("LLAMA_3_1_Q8_INSTRUCT", "llama3.1:8b-instruct-q8_0"),
    ("FALCON_3", "falcon3:10b-instruct-q8_0"),
    ("PHI_4", "phi4:14b"),
    ("DEEPSEEK_R1", "deepseek-r1:14b"),
    ("GEMMA4", "gemma4:12b-it-qat"),
    ("QWEN_3_5_9B", "qwen3.5:9b-q4_K_M"),
    ("GLM_4_6V_FLASH_10B", "glm-4.6v-flash-unsloth:latest-hotfixed"),
]
REASONING_MODEL = "deepseek-r1:14b"

# Data set -> (left file, right file, ground-truth file); every file name ends in "clean.csv".
DATASET_FILES = {
    "D1": ("rest1", "rest2", "gt"),
    "D2": ("buy", "abt", "gt"),
    "D3": ("amazon", "gp", "gt"),
    "D4": ("acm", "dblp", "gt"),
    "D10": ("dbpedia", "imdb", "gt"),
}

# Field separator of each data set's files.
DATASET_SEPARATORS = {"D2": "|", "D3": "#", "D4": "%", "D10": "|"}
