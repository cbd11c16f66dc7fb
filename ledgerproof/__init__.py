"""Wallet-statement verification as Spark DataFrame operators."""
