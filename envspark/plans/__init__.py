"""Composite analytic jobs (I*, J*, K*, L*, M*) as DataFrame -> DataFrame functions."""
