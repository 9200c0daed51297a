"""Training-data operators over the texts and feature vectors of a loop library.

The records are loop files with the printed text that belongs to each, ``(file_id, report)``, golden reports kept apart for
evaluation, ``(golden_id, report)``, and feature vectors, ``(file_id, features, category)``. Column names are parameters.
"""
