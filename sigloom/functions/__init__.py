"""Part of sigloom."""
