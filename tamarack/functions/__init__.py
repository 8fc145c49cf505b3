"""Part of tamarack."""
