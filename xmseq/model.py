"""Column names and fixed values of the data model."""

# Column names.
MARKET = "market"
USER = "user_id"
ITEM = "item_id"
TIME = "ts_sec"
VECTOR = "item_emb"
TITLE = "title"
DESCRIPTION = "description"
TEXT = "text_feature"
POS = "pos"
EVENTS = "n_events"
SEQ = "item_id_list"
LENGTH = "item_length"
PHASE = "phase"
IID = "iid"

# The many-valued column first: sorts then compare it before the market.
USER_KEY = [USER, MARKET]
ITEM_KEY = [ITEM, MARKET]

# They must equal the public format and protocol for results to agree.
MARKETS = ["ca", "de", "fr", "in", "jp", "mx", "uk", "us"]
MARKET_FILE_SUFFIX = "_5core.txt"
DATE_FORMAT = "yyyy-MM-dd"
MAX_LENGTH = 50
N_NEGATIVES = 99
TOP_K = [5, 10, 20]
VALID_METRIC = "MRR@10"
HEADS = 4
HIDDEN_ACT = "gelu"
LAYER_NORM_EPS = 1e-12
ALPHA = 1.2
BETA = 0.99
TEXT_BATCH = 4
LEAKY_SLOPE = 0.01
INTER_HEADER = {USER: "user_id:token", ITEM: "item_id:token", TIME: "timestamp:float"}
ITEM_HEADER = {ITEM: "item_id:token", VECTOR: "item_emb:float_seq"}
PLAIN_WEIGHT = "trm_encoder.layer.multi_head_attention.{}.weight"
LAYER_WEIGHT = r"^trm_encoder\.layer\.(\d+)\.multi_head_attention\.(\w+)\.weight$"
