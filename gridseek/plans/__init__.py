"""Plan helpers: durable intermediate tables and size-checked broadcasts."""

from gridseek.plans.durable import broadcast_if_small, discard, materialize, release, shared_dir, unused
from gridseek.plans.stages import Stages, fingerprint

__all__ = ["Stages", "broadcast_if_small", "discard", "fingerprint", "materialize", "release", "shared_dir", "unused"]
