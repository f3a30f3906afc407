"""basketry: frequent and closed itemset mining as Spark DataFrame plans."""

from basketry.session import build_session, checkpoint_dir, cut, scratch_path  # noqa: F401
