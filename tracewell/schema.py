"""Explicit schemas of the central tables; nothing is inferred."""

from pyspark.sql import types as T


def _row(**kinds: T.DataType | str) -> T.StructType:
    out = T.StructType()
    for name, kind in kinds.items():
        out.add(name.removesuffix("_"), kind)
    return out


#: The input of every detector. ts is in epoch seconds, 0 for missing.
TRANSFERS = _row(tx_hash="string", block_number="long", ts="double", from_address="string", to_address="string", value="double", is_contract_call="boolean", method_id="string")
FLAT = _row(tx_hash="string", block_number="long", timestamp="string", from_address="string", to_address="string", value_eth=T.DecimalType(38, 18), is_contract_call="boolean", gas_used="long", status="integer")
_TX = _row(hash="string", from_="string", to="string", value="string", input="string", gas="string")
_RECEIPT = _row(transactionHash="string", status="string", gasUsed="string")
RAW_BLOCK = _row(block_number="long", fetched_at="string", network="string", transaction_count="integer", transactions=T.ArrayType(_TX), receipts=T.ArrayType(_RECEIPT))
SERVICE_LABELS = _row(address="string", category="string")

_BLOCK, _PAIR, _VALUE = _row(number="long", timestamp="string"), _row(from_="string", to="string"), _row(eth="double")
_FORENSICS, _GAS = _row(is_contract="boolean", method_id="string", transaction_index="integer"), _row(gas_used="long")
#: A transaction as a document of its own.
FLAT_DOC = _row(tx_hash="string", block=_BLOCK, address_pair=_PAIR, value=_VALUE, forensics=_FORENSICS, gas=_GAS)
#: What the transform job writes, and its marks of blocks that are done.
TRANSFORMED = _row(block_range="long", block_number="long", tx_hash="string", from_address="string", to_address="string", value_eth="double", is_contract_call="boolean", method_id="string", derived="string")
BLOCK_MARKS = _row(block_range="long", block_number="long")
