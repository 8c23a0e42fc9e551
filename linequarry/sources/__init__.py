"""File trees, roots, candidate caches, run histories."""
