"""Reusable plan shapes that stay parallel when one key holds most rows."""
