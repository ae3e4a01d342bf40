from .repository import PrunePlan, Repository, chain_members, open_repository, plan_prune, prune, restore_plan, verify
from .resumable import backup_resumable, resume_state
from .snapshots import IdentityMismatch, backup_full, backup_incremental, restore_table, verify_snapshots

__all__ = [name for name in dir() if not name.startswith("_")]
