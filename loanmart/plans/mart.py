"""Where the tables of a data mart live."""

from __future__ import annotations

from dataclasses import dataclass

from .. import schemas as S

RAW_TABLES = {
    "attributes": S.ATTRIBUTES,
    "clickstream": S.CLICKSTREAM,
    "financials": S.FINANCIALS,
    "ledger": S.LEDGER,
}


@dataclass(frozen=True)
class Mart:
    root: str

    def raw_snapshots(self, table: str) -> str:
        return f"{self.root}/raw/{table}"

    def clean(self, table: str) -> str:
        return f"{self.root}/clean/{table}"

    def rejects(self, table: str) -> str:
        return f"{self.root}/rejects/{table}"

    def audit(self, table: str) -> str:
        return f"{self.root}/audits/{table}"

    def export(self, record: str) -> str:
        return f"{self.root}/exports/{record}"

    @property
    def labels(self) -> str:
        return f"{self.root}/gold/labels"

    @property
    def features(self) -> str:
        return f"{self.root}/gold/features"

    def view(self, run_date: str) -> str:
        return f"{self.root}/gold/views/run_date={run_date}"

    def inference(self, run_date: str) -> str:
        return f"{self.root}/gold/inference/run_date={run_date}"

    def encoded(self, kind: str, run_date: str) -> str:
        return f"{self.root}/gold/encoded_{kind}/run_date={run_date}"

    def encoder_params(self, run_date: str) -> str:
        return f"{self.root}/models/encoders/run_date={run_date}"

    def model(self, kind: str, run_date: str) -> str:
        return f"{self.root}/models/{kind}/run_date={run_date}"

    @property
    def register(self) -> str:
        return f"{self.root}/models/register"

    @property
    def outbox(self) -> str:
        return f"{self.root}/outbox"

    def monitoring(self, record: str) -> str:
        return f"{self.root}/monitoring/{record}"
