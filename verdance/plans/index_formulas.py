"""Formulas of the spectral indices as text: what the queries' SQL and the tests are made of, apart from the library's own columns.

Five follow the surveyed list where it departs from the literature: NPQI (735 nm), CUR (a difference), PRI_CI (equal to PSRI), and
the precedence in RNIR_CRI550 and RNIR_CRI700.
"""

from __future__ import annotations

import re

# R is the reflectance at a wavelength in nm, M(a, b) the mean of the bands strictly between two.
FORMULAS = {
    "DMC_NDVI": "(M(695,831)-M(600,676))/(M(695,831)+M(600,676))",
    "ADS100_NDVI": "(M(808,882)-M(619,651))/(M(808,882)+M(619,651))",
    "DMC_G2R": "M(514,600)/M(600,676)",
    "ADS100_G2R": "M(525,585)/M(619,651)",
    "NDVI": "(R800-R670)/(R800+R670)",
    "RDVI": "(R800-R670)/sqrt(R800+R670)",
    "SR": "R800/R670",
    "mod_SR": "(R800/R670-1)/(sqrt(R800/R670)+1)",
    "OSAVI": "1.16*(R800-R670)/(R800+R670+0.16)",
    "MSAVI": "(2*R800+1-sqrt((2*R800+1)*(2*R800+1)-8*(R800-R670)))/2",
    "TVI": "0.5*(120*(R750-R550)-200*(R670-R550))",
    "MTVI1": "1.2*(1.2*(R800-R550)-2.5*(R670-R550))",
    "MTVI2": "1.2*(1.2*(R800-R550)-2.5*(R670-R550))/sqrt((2*R800+1)*(2*R800+1)-(6*R800-5*sqrt(R670))-0.5)",
    "MCARI1": "1.2*(2.5*(R800-R670)-1.3*(R800-R550))",
    "MCARI2": "1.2*(2.5*(R800-R670)-1.3*(R800-R550))/sqrt((2*R800+1)*(2*R800+1)-(6*R800-5*sqrt(R670))-0.5)",
    "EVI": "2.5*(R800-R670)/(R800+6*R670-7.5*R400+1)",
    "LIC1": "(R800-R680)/(R800+R680)",
    "VOG1": "R740/R720",
    "VOG2": "(R734-R747)/(R715+R726)",
    "VOG3": "(R734-R747)/(R715+R720)",
    "GM1": "R750/R550",
    "GM2": "R750/R700",
    "TCARI": "3*((R700-R670)-0.2*(R700-R550)*(R700/R670))",
    "TCARI_over_OSAVI": "3*((R700-R670)-0.2*(R700-R550)*(R700/R670))/(1.16*(R800-R670)/(R800+R670+0.16))",
    "CI": "R750/R710",
    "SRPI": "R430/R680",
    "NPQI": "(R415-R735)/(R415+R735)",
    "NPCI": "(R680-R430)/(R680+R430)",
    "CTRI1": "R695/R420",
    "CTRI2": "R695/R760",
    "datt_CabCx_c": "R672/(R550*3*R708)",
    "datt_NIRCabCx_c": "R860/(R550*R708)",
    "SIPI": "(R800-R445)/(R800+R680)",
    "CRI550": "1/R515-1/R550",
    "CRI700": "1/R515-1/R700",
    "RNIR_CRI550": "1/R515-1/R550*R770",
    "RNIR_CRI700": "1/R515-1/R700*R770",
    "PSRI": "(R680-R500)/R750",
    "LIC3": "R440/R740",
    "RARS": "R513/R746",
    "PSSRa": "R800/R675",
    "PSSRb": "R800/R650",
    "PSSRc": "R800/R500",
    "PSNDc": "(R800-R470)/(R800+R470)",
    "PRI570": "(R570-R531)/(R570+R531)",
    "PRI515": "(R515-R531)/(R515+R531)",
    "PRI512": "(R512-R531)/(R512+R531)",
    "PRI600": "(R600-R531)/(R600+R531)",
    "PRI670": "(R670-R531)/(R670+R531)",
    "PRI670_570": "(R570-R531-R670)/(R570+R531+R670)",
    "PRIn": "((R570-R531)/(R570+R531))/abs((R800-R670)/sqrt(R800+R670)*R700/R670)",
    "PRI_CI": "(R680-R500)/R750",
    "CUR": "(R675-R690)/(R683*R683)",
    "Redness": "R700/R670",
    "Greenness": "R570/R670",
    "Blue_index": "R450/R490",
    "BGI1": "R400/R550",
    "BGI2": "R450/R550",
    "BRI1": "R400/R690",
    "BRI2": "R450/R690",
    "LIC2": "R440/R690",
    "NDRE": "(R790-R720)/(R790+R720)",
    "DCNI": "(R720-R700)*(R700-R670)/((R720-R670)+0.3)",
    "MCARI_1510": "((R700-R1510)-0.2*(R700-R550))*(R700/R1510)",
    "TCARI_1510": "3*((R700-R1510)-0.2*(R700-R550))*(R700/R1510)",
    "TOCARI_1510": "(3*((R700-R1510)-0.2*(R700-R550))*(R700/R1510))/(1.16*(R800-R1510)/(R800+R1510+0.16))",
    "RSI_990": "R990/R720",
    "CI1": "(R736-R735)*(R990/R720)",
    "CI2": "(R736-R735)*(R900/R720)",
    "NDNI": "(log(1/R1510)-log(1/R1680))/(log(1/R1510)+log(1/R1680))",
    "GnyLi": "((R900*R1050)*(R955*R1220))/((R900*R1050)+(R955*R1220))",
    "N1645": "(R1645-R1715)/(R1645+R1715)",
    "N870": "(R870-R1450)/(R870+R1450)",
    "S1080": "(R1080-R660)/(R1080+R660)",
    "S1260": "(R1260-R660)/(R1260+R660)",
}


def index_sql(name: str, bands) -> str:
    """The formula as DuckDB SQL over ``bands``, which give the SQL text of a wavelength's band and of a range's mean."""

    def term(m: re.Match) -> str:
        if m["low"]:
            return f"({bands.mean(int(m['low']), int(m['high']))})"
        return bands[int(m["nm"])] if m["nm"] else f"{float(m['number'])!r}::DOUBLE"

    text = re.sub(r"M\((?P<low>\d+),(?P<high>\d+)\)|R(?P<nm>\d+)|(?P<number>\d+(?:\.\d+)?)", term, FORMULAS[name])
    return text.replace("log(", "ln(")
