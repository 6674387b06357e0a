"""Fixed values shared by the operators."""

# Reserved vocabulary entries, in id order.
RESERVED = [
    (0, "<pad>", "control"),
    (1, "<s>", "control"),
    (2, "</s>", "control"),
    (3, "<unk>", "unknown"),
    (4, "[SEP]", "control"),
    (5, "[CLS]", "control"),
    (6, "[MASK]", "control"),
    (7, "<n>", "user"),
]
PAD_ID = 0
EOS_ID = 2
UNK_ID = 3
NEWLINE_ID = 7
NEWLINE_PIECE = "<n>"
FIRST_LEARNED_ID = 8
SPECIAL_PIECES = ["<pad>", "<s>", "</s>", "<unk>", "[SEP]", "[CLS]", "[MASK]"]
SPACE_MARK = "▁"
LABEL_IGNORE = -100

# Article markup markers.
START_PARAGRAPH = "_START_PARAGRAPH_"
MARKUP_NEWLINE = "_NEWLINE_"

# Defaults of the corpus and vocabulary jobs.
DEFAULT_SHARDS = {"train": 48, "validation": 4, "test": 4}
DEFAULT_SEED = 42
MODEL_MAX_LENGTH = 1024
MIN_TAIL = 10
PACK_BATCH_ROWS = 1000
VOCAB_SIZE = 50_000
CHARACTER_COVERAGE = 0.9995

# First words of file names that tell a split.
SPLIT_NAMES = {
    "train": ["train", "training"],
    "validation": ["validation", "valid", "val", "dev"],
    "test": ["test", "testing"],
}

# A vocabulary above this many pieces is never broadcast or collected.
MAX_BROADCAST_PIECES = 2_000_000
