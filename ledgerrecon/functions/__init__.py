from ledgerrecon.functions.amounts import (
    AMOUNT, AMOUNT_SCALE, amount, duplicate_columns, first_scalar, invert_value, number_or_zero, parse_number,
)
from ledgerrecon.functions.flags import is_blank, truthy, unflagged
from ledgerrecon.functions.keys import composite_key, key_part
from ledgerrecon.functions.presentation import title_words, translate_status, yes_no
from ledgerrecon.functions.refs import column_type, ref
from ledgerrecon.functions.verdict import classify, verdict

__all__ = [
    "AMOUNT", "AMOUNT_SCALE", "amount", "classify", "column_type", "composite_key", "duplicate_columns",
    "first_scalar", "invert_value", "is_blank", "key_part", "number_or_zero", "parse_number", "ref",
    "title_words", "translate_status", "truthy", "unflagged", "verdict", "yes_no",
]
