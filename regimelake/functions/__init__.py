"""Part of the chain-regime operators."""
