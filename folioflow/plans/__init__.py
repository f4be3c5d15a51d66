"""Whole jobs composed of operators."""
from folioflow.plans.jobs import EditResult, build_prompts, edit_files, publish_edits

__all__ = ["EditResult", "build_prompts", "edit_files", "publish_edits"]
