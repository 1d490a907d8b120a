"""Training-data operators: media, filters, tokenisers, near-duplicate search.

Nothing outside this folder imports it; the registry adds its queries only
when the folder is present.
"""
