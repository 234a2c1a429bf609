"""Fixed schemas and the names that sources use for their columns."""

TRADES = "trade_id string, condition_id string, token_id string, side string, price double, size double, notional double, outcome_label string, outcome_index tinyint, wallet string, tx_hash string, traded_at timestamp, ingest_at timestamp, source_file string"
MARKETS = "condition_id string, question string, slug string, token_yes string, token_no string, winning_token_id string, winning_outcome string, resolved boolean, resolved_at timestamp, closed_at timestamp, end_date timestamp, volume double, liquidity double, neg_risk boolean, ingest_at timestamp"
MARKET_TOKENS = "condition_id string, token_id string, outcome_label string, outcome_index int"

TRADE_ALIASES = {
    "condition_id": ("conditionId", "market", "market_id"), "token_id": ("asset", "asset_id", "tokenId"), "traded_at": ("timestamp", "time", "created_at", "createdAt"),
    "wallet": ("proxyWallet", "maker", "user"), "tx_hash": ("transactionHash", "transaction_hash"), "outcome_label": ("outcome",), "outcome_index": ("outcomeIndex",), "size": ("amount", "shares"),
}
MARKET_ALIASES = {
    "condition_id": ("conditionId",), "token_ids": ("clobTokenIds",), "outcome_prices": ("outcomePrices",), "closed_at": ("closedTime", "closed_time"), "end_date": ("endDate",), "resolved_at": ("resolvedAt",),
    "neg_risk": ("negRisk",), "volume": ("volumeNum",), "liquidity": ("liquidityNum",), "winning_outcome": ("winningOutcome",), "token_yes": ("tokenYes", "token1"), "token_no": ("tokenNo", "token2"),
}


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def types(schema: str) -> dict[str, str]:
    return dict(c.split() for c in schema.split(", "))
