"""Settings of an agent and its log, with their established defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class AgentSettings:
    # Defaults that existing configurations rely on.
    state_dim: int = 4
    action_dim: int = 3
    seed: int = 42
    flush_every: int = 64
    rotate_bytes: int = 256 << 20
    queue_capacity: int = 4096
    drop_when_full: bool = False
    data_dir: str = "data"
    prefix: str = "exp"

    def writer(self):
        """A log writer with these settings."""
        from .sources.xlog import Writer

        return Writer(self.data_dir, self.prefix, self.rotate_bytes, flush_every=self.flush_every)

    def policy(self):
        from .operators.policy import Policy

        return Policy.fresh(self.state_dim, self.action_dim, self.seed)
