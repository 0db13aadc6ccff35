"""Composed analyses: the reference's end-to-end stages expressed as lazy DataFrame plans."""
