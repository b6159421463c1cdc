"""Fixed values shared by the whole package.

These texts are part of the result format: verdict statuses and groups, the
words that count as true or cancelled, the presentation labels and the cell
texts a delimited file uses for "missing". They are written out once, here.
"""

# --- fixed values: verdicts -------------------------------------------------
BOTH_ZERO = "Ambos zero"
AGREE = "Conferem"
ONLY_A = "Apenas A"
ONLY_B = "Apenas B"
DIVERGENT = "Divergência"

RECONCILED = "Conciliados"
NOT_RECONCILED = "Não conciliados"

STATUSES = (BOTH_ZERO, AGREE, ONLY_A, ONLY_B, DIVERGENT)

# (status, label, description), in presentation order
STATUS_LABELS = (
    (BOTH_ZERO, "Ambos zero", "Ambos os lados são zero"),
    (AGREE, "Conferem", "Valores coincidem dentro do limite"),
    (ONLY_A, "Apenas A", "Presente somente na base A"),
    (ONLY_B, "Apenas B", "Presente somente na base B"),
    (DIVERGENT, "Divergência", "Ambos presentes, valores divergentes além do limite"),
)
GROUP_LABELS = (
    (RECONCILED, "Conciliados", "Considerados conciliados"),
    (NOT_RECONCILED, "Não conciliados", "Considerados não conciliados"),
)

# --- fixed values: reversal results -----------------------------------------
REVERSAL_STATUS = "Conciliado_Estorno"
REVERSAL_GROUP = "01_Conciliado"

# --- fixed values: run states -----------------------------------------------
RUN_COMPLETED = "completed"

# --- fixed values: flag and enrichment columns ------------------------------
CANCELED_FLAG = "__is_canceled__"
REVERSAL_FLAG = "__is_reversal__"
ENRICHED_COLUMNS = ("status", "group_name", "key_used")
MERGED_COLUMNS = ("recon_key_name", "recon_status", "recon_group", "recon_difference")

# --- fixed values: tokens ---------------------------------------------------
TRUE_TOKENS = ("1", "true", "yes", "y", "t")
CANCELED_TOKENS = ("S", "1", "TRUE", "YES", "Y", "T")
YES_WORDS = ("1", "true", "t", "y", "yes", "sim")
NO_WORDS = ("0", "false", "f", "n", "no", "nao", "não")
YES_LABEL = "Sim"
NO_LABEL = "Não"

# --- fixed values: presentation ---------------------------------------------
STATUS_TRANSLATION = {
    "matched": "Conciliado",
    "reconciled": "Conciliado",
    "unmatched": "Não conciliado",
    "mismatch": "Divergência",
    "both_zero": "Ambos zero",
    "Ambos zero": "Ambos zero",
    "Conferem": "Conferem",
    "Apenas A": "Apenas A",
    "Apenas B": "Apenas B",
}
HEADER_TRANSLATION = {
    "group_name": "Grupo",
    "key_used": "Chave Usada",
    "__is_canceled__": "Cancelado",
    "__is_reversal__": "Estorno",
    "status": "Status",
}

# --- fixed values: null filling ---------------------------------------------
STRING_FILL = "NULL"
NUMBER_FILL = 0

# --- fixed values: numbers written as text ----------------------------------
CURRENCY_MARKS = r"R\$|[$€£ ]"
TRAILING_MARKS = r"[%;:,.]+$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
READY_NUMBER = r"^[+-]?\d+(\.\d+)?$"
WHOLE_NUMBER = r"^[+-]?\d+$"
NESTED_VALUE_FIELDS = ("value", "val", "amount", "amt")

# --- fixed values: file formats and cells that mean "missing" ---------------
TEXT_FORMATS = ("csv", "txt")
SPREADSHEET_FORMATS = ("excel", "xls", "xlsx")
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
BOOLEAN_CELLS = ("True", "TRUE", "true", "False", "FALSE", "false")
HEADER_SCAN_ROWS = 10
HEADER_SCAN_SHARE = 0.3
PREVIEW_ROWS = 50
PAGE_ROWS = 100
